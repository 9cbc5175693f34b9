from types import SimpleNamespace

from clearstack.config import Config
from clearstack.plans import queries, reconstruct


def test_reconstruction_query_runs_with_the_default_radii(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(reconstruct, "reconstruct", lambda *args: seen.append(args[-1]) or SimpleNamespace(pixels=None))
    queries.reconstruction(spark, "/root/testdata/sf0.001")
    assert seen == [Config()]
