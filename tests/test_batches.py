"""How much text a Python worker is handed at once."""

from textforge.operators import rules
from textforge.plans.jobs import RULES


def test_reading_rows_bounds_batches(spark):
    names = [f"spark.sql.execution.arrow.{n}" for n, _ in rules.BATCH]
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "10000")
        spark.conf.set(names[1], str(1 << 28))
        df = spark.createDataFrame([("be", "t", "d", "c", "l")], "market string, title string, description string, company string, location string")
        RULES.read(df)
        assert {n: int(spark.conf.get(n)) for n in names} == {names[0]: 512, names[1]: 1 << 24}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
