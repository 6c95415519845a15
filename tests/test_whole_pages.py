"""Page operators without an oracle see every line of a page."""

import pytest

from quoin.plans import catalog, pages  # noqa: F401


@pytest.mark.parametrize(("name", "ids"), [("horizontal_merge", "transform(merged_ids, x -> int(split(x, '_')[0]))"), ("vertical_merge", "transform(merged_ids, x -> int(x))"), ("wrapped_font_fit", "array(line_no)"), ("box_suppression", "array(line_no)"), ("draw_operations", "array(block_no)")])
def test_every_line_is_seen(spark, tmp_path, name, ids):
    rows = [(1, "\n".join(f"line number {i} of a long document" for i in range(120)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {i for r in catalog.QUERIES[name](spark, str(tmp_path)).selectExpr(f"{ids} AS ids").collect() for i in r["ids"]}
    # Boxes that are nine points higher than a line overlap their neighbours by less than the threshold of suppression.
    assert got == set(range(120))
