import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from forecastops.llm import url_filter as u

globs = st.lists(st.text("ab/.?*", max_size=12), min_size=1, max_size=14)
texts = st.lists(st.text("ab/.é", max_size=20), max_size=6)


def plain(glob):
    out = re.sub(r"\*\*|\*|\?|[^*?]", lambda m: {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(m[0], re.escape(m[0])), glob)
    return re.compile(out.encode("latin1").decode("latin1") + r"\Z")


@settings(max_examples=300, deadline=None)
@given(globs, texts)
def test_automaton_against_regular_expressions(patterns, strings):
    found = u.ShiftAnd(patterns).match([s.encode() for s in strings])
    for i, s in enumerate(strings):
        # One symbol of the automaton is one byte.
        assert found[i].tolist() == [bool(plain(p).match(s.encode().decode("latin1"))) for p in patterns], s


def test_escapes_and_many_words():
    assert u.ShiftAnd([r"a\*b", r"\?"]).match([b"a*b", b"axb", b"?"]).tolist() == [[True, False], [False, False], [False, True]]
    many = [f"**x{k}y**" for k in range(300)]
    assert u.ShiftAnd(many).match([b"--x217y--"])[0].nonzero()[0].tolist() == [217]


def test_judgements(spark):
    urls = [(1, "https://www.example.com/en/x"), (2, "http://A.Example.com/en/1?x"), (3, "https://foo.net/es/"), (4, None), (5, "nope"),
            (6, "https://x.spam-farm.example.org/en"), (7, "http://com"), (8, "x://net/fr/a://b"), (9, "http://zcom/"), (10, "http://a.com/x"),
            (10, "http://a.com/x"), (None, "http://a.com:80/x"), (11, "http://É.NET/fr/"), (12, "http://b.com/" + "y" * 100_000)]
    got = u.filter_urls(spark.createDataFrame([(*r, "c", "d") for r in urls], "page_id long, url string, host string, verdict string")).toPandas()
    key = {(None if pd.isna(r.page_id) else int(r.page_id)): (r.host, r.rule, r.verdict) for r in got.itertuples()}
    assert len(got) == len(urls)
    assert key[1] == ("www.example.com", "www.example.com/en/", "allow") and key[2] == ("a.example.com", "example.com/en/", "block")
    assert key[3][1:] == ("net/es/", "block") and key[4] == ("", None, "allow") and key[5] == ("", None, "allow")
    assert key[6][1:] == (None, "block") and key[7] == ("com", None, "allow") and key[8][1:] == ("net/fr/", "block")
    assert key[9][1] is None and key[10][1:] == ("com/", "allow") and key[None] == ("a.com:80", None, "allow")
    assert key[11][:2] == ("É.net", "net/fr/") and key[12][1:] == ("com/", "allow")
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
