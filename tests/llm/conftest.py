import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a null id, and columns whose names operators use themselves."""
    texts = [None, "", " \n\t", "one", "a b c d e f g h i j.\na b c d e f g h i j.", "x " * 3000, "under the mit license cc by nc cc by nc", "Ünïcode wörds <|endoftext|> ½ ＡＢ é"]
    rows = [(i, t, "s", i) for i, t in enumerate(texts)] + [(3, "one", "s", 3), (None, "no id here", "s", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, slot bigint")
