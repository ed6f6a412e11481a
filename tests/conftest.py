import pytest

from postmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        master="local[8]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows([...dicts...], ddl) -> DataFrame"""

    def make(data, ddl):
        from pyspark.sql.types import _parse_datatype_string

        names = _parse_datatype_string(ddl).fieldNames()
        return spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], ddl)

    return make
