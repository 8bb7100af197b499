"""o04 covers zeros, blanks, signs and texts without a leading number, over whole texts."""

from leafquarry.plans.catalogue import QUERIES


def test_leading_numbers(spark, tmp_path):
    rows = [(i, None if i == 8 else "texto 7", "es", "s", 7) for i in range(9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.result for r in sorted(QUERIES["o04_leading_number"](spark, str(tmp_path)).collect())]
    assert got == ["1|1", "2|2", "3|0", "4|-4", "5|5", "6|6", "7|0", "8|-8", "0|9"]
