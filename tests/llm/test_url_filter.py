import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ratioscope.llm.url_filter import HostRule, ShiftAnd, filter_urls, split_url


def as_regex(glob):
    out = "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", glob))
    return re.compile(out.encode(), re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/*", max_size=6), min_size=1, max_size=9), st.lists(st.text("ab/", max_size=8), min_size=1, max_size=5))
def test_automaton_equals_regular_expressions(globs, urls):
    hit = ShiftAnd(globs).match([u.encode() for u in urls])
    assert hit.tolist() == [[bool(as_regex(g).fullmatch(u.encode())) for g in globs] for u in urls]


def test_many_words_of_state():
    globs = [f"*{'x' * i}y{i}**" for i in range(60)]
    urls = [f"aa{'x' * i}y{i}/z".encode() for i in range(60)]
    hit = ShiftAnd(globs).match(urls)
    assert ShiftAnd(globs).words > 10 and hit.tolist() == [[bool(as_regex(g).fullmatch(u)) for g in globs] for u in urls]


def test_split_url():
    assert split_url("HTTP://Www.Ä.COM/A?b#c") == ("www.Ä.com", "/A")
    assert split_url("x://h?y/z") == ("h", "") and split_url("x://h#/") == ("h", "") and split_url("no scheme/") == ("", "")
    assert split_url(None) == ("", "") and split_url("a://b://c") == ("b:", "//c")


def test_rules_and_edges(spark):
    urls = ["http://a.net/x", "http://net/", "http://planet/x", "http://example.net/en/1", "http://sub.EXAMPLE.net/en/", "http://example.net/en", "http://a.com/x.net/", "http://net", None, "", "http://big-casino.org/", "http://casino.net/x"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [HostRule("net/", "block"), HostRule("example.net/en/", "allow")]
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, rules, ["*casino*/**"]).collect()}
    assert [got[i] for i in range(12)] == [("net/", "block"), ("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), ("net/", "block")]
    assert filter_urls(df.limit(0), rules, []).count() == 0 and filter_urls(df, [], []).where("verdict = 'allow'").count() == 12
