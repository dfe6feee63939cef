"""Logs are decoded from one reading of the tape, by columns."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.registry import QUERIES, load
from tidemark.sources import chain

load()


def test_three_kinds_of_event_read_the_tape_once(spark, sf_dir):
    plan = QUERIES["decoded_logs_v2"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Python" not in plan


def test_words_of_any_width_are_decimal(spark):
    rng = random.Random(1)
    numbers = [0, 1, 10**9, 2**60 - 1, 2**60, 2**255, 2**256 - 1, 10**77, *[rng.getrandbits(rng.randrange(1, 257)) for _ in range(300)]]
    df = spark.createDataFrame([(f"0x{x:064x}", str(x)) for x in numbers], "data string, want string")
    assert df.where(chain.word_int(F.col("data"), 0) != F.col("want")).count() == 0
    assert df.where(chain.word_int(F.upper("data"), 0) != F.col("want")).count() == 0


def test_a_missing_word_is_an_error(spark):
    with pytest.raises(Exception, match="hexadecimal"):
        spark.createDataFrame([("0x",)], "data string").select(chain.word_int(F.col("data"), 0)).collect()
