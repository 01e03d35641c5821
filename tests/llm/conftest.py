import pytest
from llm_cases import DOCS, EXTRA, awkward


@pytest.fixture
def folder(spark, tmp_path):
    """A function that writes tables to a folder and gives its path."""

    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def docs_folder(folder):
    def write(rows=None, **tables):
        rows = awkward() if rows is None else rows
        wide = [(*r, *(f"clash {c}" for c in EXTRA)) for r in rows]
        schema = DOCS + "".join(f", {c} string" for c in EXTRA)
        return folder(documents=(wide, schema), **tables)

    return write
