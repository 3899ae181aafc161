import pytest


@pytest.fixture
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def duck(small_sf):
    from staylens.plans.compare import duck_connection

    return duck_connection(small_sf)
