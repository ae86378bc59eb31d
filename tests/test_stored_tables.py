"""Tables written on the way are compressed well."""

import glob

from runledger.session import cut_to_table, shared_dir


def test_stored_tables_use_zstd(spark):
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/table-*/*.parquet"))
    rows = cut_to_table(spark.range(50).selectExpr("id", "repeat('x', 40) AS line"))
    files = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/table-*/*.parquet")) - before
    assert rows.count() == 50 and files and all(f.endswith(".zstd.parquet") for f in files)
