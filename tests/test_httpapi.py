"""The HTTP routes and their client."""

import threading

import pytest

from textloom.httpapi import Client, ClientError, make_server


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    server = make_server(spark, f"file://{tmp_path_factory.mktemp('http')}/index", port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Client(f"http://127.0.0.1:{server.server_address[1]}")
    server.shutdown()


def test_routes(client):
    assert client.health() == {"status": "ok"}
    assert [c["text"] for c in client.chunk("Cats sleep. Dogs bark.", chunker="sentence", size=11)] == ["Cats sleep.", " Dogs bark."]
    assert client.sources() == []
    assert client.index("Cats sleep all day.", source="a/b")["indexed"] == 1
    assert client.index("Rockets fly.")["indexed"] == 1
    hits = client.search("cats", k=1, scoring="bm25")
    assert hits[0]["record"]["source"] == "a/b" and hits[0]["score"] == 1
    assert client.search("cats", source="")[0]["record"]["chunk"]["text"] == "Rockets fly."
    assert client.index("Cats eat.", source="a/b", replace=True)["indexed"] == 1
    assert {(s["name"], s["count"]) for s in client.sources()} == {("a/b", 1), ("", 1)}
    assert client.delete_source("a/b") == 1 and client.delete_source("a/b") == 0


@pytest.mark.parametrize(
    ("method", "path", "body", "status"),
    [
        ("POST", "/v1/chunk", {"more": 1}, 400), ("POST", "/v1/chunk", {"text": 1}, 400), ("POST", "/v1/chunk", {"text": "x", "size": 0}, 400), ("POST", "/v1/search", {"query": ""}, 400), ("POST", "/v1/search", {"query": "x", "k": -1}, 400),
        ("GET", "/v1/chunk", None, 405), ("GET", "/none", None, 404), ("POST", "/v1/search", {"query": "x", "scoring": "other"}, 400),
    ],
)
def test_errors(client, method, path, body, status):
    with pytest.raises(ClientError) as e:
        client._call(method, path, body)
    assert e.value.status == status
