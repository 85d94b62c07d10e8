"""URL rules by expression and by join agree; trees judge hosts that they have not seen."""

import random

import pytest
from test_corpus import URLS, WORDS, plain_verdict

from pixeltide.llm import urlfilter


@pytest.mark.parametrize("most", [urlfilter.MOST_RULES, 0])
def test_rules_by_expression_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "MOST_RULES", most)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    got = urlfilter.judged_urls(pages).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = plain_verdict(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_many_rules_are_joined(spark):
    rng = random.Random(4)
    rules = tuple(urlfilter.rule(rng.choice(["allow", "block"]), f"{rng.choice(WORDS)}.{rng.choice(['com', 'net'])}/{rng.choice(['', 'a', 'a/', 'ab/c'])}{k if k % 3 else ''}") for k in range(3000))
    urls = [f"http://{rng.choice(['', 'x.', 'y.x.'])}{rng.choice(WORDS)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['', 'a', 'a/', 'ab/c'])}{rng.randrange(3000)}" for _ in range(400)]
    source = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = urlfilter.url_parts(source.url)
    for r in urlfilter.with_rule(source.withColumns({"host": host, "path": path}), rules).collect():
        fits = [x for x in rules if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.text), len(x.host), x.verdict == "block"), default=None)
        assert (r.rule, r.by_rule) == ((best.text, best.verdict) if best else (None, None)) or (best and (r.rule, r.by_rule) in {(x.text, x.verdict) for x in fits if len(x.text) == len(best.text)})


def test_hosts_never_seen_are_judged_by_their_looks(spark):
    """One blocked host in ten under each suffix looks like any other; labels are nine to one."""
    rng = random.Random(6)
    bad = lambda: (f"http://x{rng.randrange(10**6)}-win.{rng.choice(['aa', 'bb'])}/{rng.randrange(10**9)}?a=1&b={rng.randrange(999)}&c=3", 1)
    good = lambda: (f"https://www.{rng.choice(WORDS)}{rng.randrange(99)}.{rng.choice(['aa', 'bb'])}/{rng.choice(WORDS)}/{rng.choice(WORDS)}.html", 0)
    labelled = spark.createDataFrame([bad() for _ in range(900)] + [good() for _ in range(100)], "url string, label int")
    for r in urlfilter.held_out_quality(labelled).collect():
        assert r.n >= 10 and r.right >= 0.95 * r.n
