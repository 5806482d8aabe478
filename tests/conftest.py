import pytest

from webskein.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
