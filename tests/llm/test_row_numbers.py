import edge_data
import pytest

from tunelake.llm import common, exact_dedup, mixing, ngram_join, suffix_dedup, warc

SPLIT = "spark.sql.files.maxPartitionBytes"


def exact(docs):
    return exact_dedup.without_duplicates(docs).select("doc_id")


def near(docs):
    return ngram_join.without_near_duplicates(docs).select("doc_id")


def repeats(docs):
    return suffix_dedup.without_repeats(docs, with_text=False).select("__id", "n_removed")


def mix(docs):
    return mixing.mixed_documents(docs).select("doc_id", "text")


def archives(docs):
    index = warc.write_archives(docs, common.scratch_path(docs.sparkSession, "warc"),
                                html="text", page_id="doc_id", url="lang")
    return index.select("page_id", "payload_digest", "refers_to")


@pytest.mark.parametrize("job", [exact, near, repeats, mix, archives])
def test_scans_split_otherwise_give_the_same(spark, tmp_path, monkeypatch, job):
    """Every table written changes the size of the splits of the scans after it."""
    rows = [(i, edge_data.prose(80, i % 45), "en", "ab"[i % 2]) for i in range(60)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(
        6, "doc_id").write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    write = common.stored

    def stored(df, label):
        out = write(df, label)
        spark.conf.set(SPLIT, "1k" if spark.conf.get(SPLIT) == "128m" else "128m")
        return out

    try:
        spark.conf.set(SPLIT, "128m")
        table = spark.read.parquet(path)
        wanted = sorted(map(tuple, job(table).collect()), key=repr)
        for module in (common, exact_dedup, mixing, ngram_join, suffix_dedup, warc):
            monkeypatch.setattr(module, "stored", stored, raising=False)
        assert sorted(map(tuple, job(table).collect()), key=repr) == wanted
    finally:
        for name in (SPLIT, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(name)
