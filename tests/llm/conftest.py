import pytest


@pytest.fixture(scope="session")
def paths():
    import public_tokenizers

    return public_tokenizers.path
