import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from tidecrawl.functions import urls
from tidecrawl.operators import filters


def one(spark, f, *values):
    rows = spark.createDataFrame([(v,) for v in values], "url string")
    return [r[0] for r in rows.select(f("url")).collect()]


@pytest.mark.parametrize("spellings", [
    ["http://lake.example/reed", "http://lake.example/reed//", "HTTP://LAKE.example:80/reed#bank", "http://ann:pw@lake.example/reed/", "  http://lake.example/reed?"],
    ["https://lake.example", "https://lake.example/", "https://lake.example:443", "https://Lake.Example:0443///"],
    ["http://lake.example/reed?depth=2&kind=/", "http://lake.example:80/reed/?depth=2&kind=/#x"],
    ["http://lake.example/Reed"], ["https://lake.example/reed"], ["http://lake.example:81/reed"], ["http://lake.example/reed?depth=3"], ["http://lake.example/reed/../reed"], ["http://[::1]/reed", "http://[::1]:80/reed"],
])
def test_keys(spark, spellings):
    """Section 6.2 of RFC 3986, as far as the key follows it: case of scheme and host, default ports; not dot segments."""
    assert len(set(one(spark, urls.normalize_url, *spellings))) == 1


def test_keys_differ(spark):
    made = one(spark, urls.normalize_url, *["http://lake.example/Reed", "http://lake.example/reed", "https://lake.example/reed", "http://lake.example:81/reed", "http://lake.example/reed?a", "http://lake.example/reed?b", "http://pond.example/reed"])
    assert len(set(made)) == len(made)


def key(url):
    p = urlsplit(url.strip())
    host = p.hostname or ""
    host = f"[{host}]" if ":" in host else host
    port = f":{p.port}" if p.port is not None and p.port != {"http": 80, "https": 443}.get(p.scheme) else ""
    return f"{p.scheme}://{host}{port}{p.path.rstrip('/') or '/'}{'?' + p.query if p.query else ''}"


def test_keys_like_a_plain_formulation(spark):
    rng = random.Random(3)
    made = []
    for _ in range(400):
        host = rng.choice(["a.test", "A.Test", "x_y.test", "[::1]", "u:p@b.test"])
        port = rng.choice(["", ":80", ":443", ":8080", ":0443"])
        made.append(f"{rng.choice(['http', 'HTTPS'])}://{host}{port}{rng.choice(['', '/', '/a//', '//p', '/A b|c'])}{rng.choice(['', '?', '?b=1&a=/'])}{rng.choice(['', '#', '#f?x'])}")
    assert one(spark, urls.normalize_url, *made) == [key(u) for u in made]


def test_bad_values(spark):
    assert one(spark, urls.normalize_url, "http://lake.example:70000/", "http://lake.example:door/", None) == [None] * 3
    assert one(spark, urls.host_of, "no address", "http://North.Lake.Example:81/reed", "ftp://b@c.d/") == ["", "north.lake.example", "c.d"]
    assert one(spark, urls.origin_of, "HTTPS://Lake.Example:81/reed?x") == ["https://lake.example:81"]
    assert one(spark, urls.agent_token, "Heron/2 (fishing)", " \t", "/x", "Heron diver/1") == ["heron", "*", "*", "heron"]


def allowed(spark, value, *args, **kwargs):
    return one(spark, lambda c: filters.allows(F.col(c), *args, **kwargs), value)[0]


def test_filters(spark):
    for u, ok in {"http://lake.example/x": True, "https://deep.north.lake.example/": True, "http://snowlake.example/": False, "http://lake.example.org/": False, "tel:123": False, "gopher://lake.example/": False, "HTTP://LAKE.example": True}.items():
        assert allowed(spark, u, ["Lake.example"]) is ok
    assert allowed(spark, "http://other.example/", ["lake.example"], same_domain_only=False)
    for u in ("/map.svg", "/boats?order=age", "/admin/boats"):
        assert not allowed(spark, f"http://lake.example{u}", ["lake.example"], exclude=[r"\.svg$", r"[?&]order=", "/admin"])
    assert not allowed(spark, "http://lake.example/shore", ["lake.example"], include=["/boats/"])
    assert not allowed(spark, "http://lake.example/boats/7", ["lake.example"], include=["(?i)/BOATS/"], exclude=["7$"]) and allowed(spark, "http://lake.example/boats/7", ["lake.example"], include=["(?i)/BOATS/"])
