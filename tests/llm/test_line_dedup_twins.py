from pyspark.sql import functions as F

from cuegrid.llm import line_dedup as ld


def test_texts_without_ids_keep_their_own_lines(spark):
    rows = []
    for i in range(1600):
        own = " ".join(f"w{i}{c}" for c in "abcdef")
        rows.append((None, f"{own}\n" + ("the same six words every time" if i % 2 else f"{own} once more")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    low = F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).alias("low")
    assert df.groupBy(low).agg(F.countDistinct(F.length("text") % 2, "text").alias("n")).filter("n > 1").count()
    got = [r.text.split("\n") for r in ld.drop_repeated_lines(df).collect()]
    assert len(got) == len(rows)
    clean = {tuple(t.split("\n")) for i, (_, t) in enumerate(rows) if i % 2 == 0}
    assert clean <= set(map(tuple, got))
    assert sum(lines[1:] == ["the same six words every time"] for lines in got) == 1
    assert sum(len(lines) == 1 for lines in got) == 799
