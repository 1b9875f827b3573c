import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def texts(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))

    def make(values, **extra):
        rows = [Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or ""), **extra) for i, t in enumerate(values)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {k} string" for k in extra))

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
