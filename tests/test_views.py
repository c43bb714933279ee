"""Views follow the tables that they stand on."""

import shutil
import time

from loomstone.plans import roles

SF = "/root/testdata/sf0.001"


def test_rewritten_tables_are_read_anew(spark, tmp_path):
    own = tmp_path / "sf"
    shutil.copytree(SF, own)
    own.chmod(0o755)
    for f in own.iterdir():
        f.chmod(0o644)
    assert roles.role(spark, str(own), "region").count() == spark.read.parquet(f"{SF}/region.parquet").count()
    time.sleep(1.1)
    part = spark.read.parquet(f"{SF}/region.parquet").toPandas().head(2)
    part.to_parquet(own / "region.parquet")
    assert roles.role(spark, str(own), "region").count() == 2
    assert roles.role(spark, SF, "region").count() == 5
