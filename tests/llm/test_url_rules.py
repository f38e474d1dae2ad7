import random
import re

from rackpulse.llm.url_rules import BLOCKED, RULES, judge_urls, mine, mined_matches, parsed

SCHEMA = "page_id bigint, url string, html string"
LABELS = "doc_id bigint, quality int, toxic int"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/x", "https://www.example.com/en/1?q#f", "http://example.com",
    "http://example.com?x=/en/", "http://x.com/", "http://notexample.com/en/", "http://badnet/es/", "http://net/es/1",
    "ftp://a.net/fr/?u", "http://a.net/FR/", "http://a.org/en/é", "x://É.COM/en/", "http://a://b/c", "http://a.com:80/en/",
    "http://www.example.com/en", "http://a.b.www.example.com/en/\nnext",
]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], None)] * 2, SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    got = judge_urls(pages.selectExpr("*", "'x' AS host", "1 AS tokens", "2 AS hit"), labels)
    rows = got.collect()
    assert len(rows) == len(URLS) + 2
    for row in rows:
        host, path = split(URLS[row.page_id] if row.page_id is not None else URLS[4])
        name, verdict = rule_of(host, path)
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, name, verdict or "allow")
    assert judge_urls(pages.limit(0), labels).count() == 0


def labelled(spark):
    rng = random.Random(31)
    pages, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        word = rng.choice(["pills", "casino"]) if bad and rng.random() < 0.9 else rng.choice(["news", "blog", "wiki"])
        pages.append((i, f"https://{word}.site{rng.randrange(4)}.org/{rng.choice('abc')}{i}/", None))
        labels += [(i, 0 if bad else 1, 0)] if i % 2 == 0 else []
    labels += [(None, 0, 1), (0, None, None), (10**6, 0, 0)]
    return spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_mined_rules_against_counting(spark):
    pages, labels = labelled(spark)
    rows = parsed(pages)
    rules = mine(rows, labels, support=0.01, confidence=0.6).collect()
    bad = {r.doc_id: 0 for r in labels.collect() if r.doc_id is not None}
    for r in labels.collect():
        if r.doc_id in bad and (r.quality == 0 or r.toxic == 1):
            bad[r.doc_id] = 1
    baskets = [(set(r.tokens), bad[r.page_id]) for r in rows.collect() if r.page_id in bad]
    assert rules
    for rule in rules:
        hit = [b for held, b in baskets if set(rule.tokens) <= held]
        assert abs(rule.confidence - sum(hit) / len(hit)) < 1e-9 and rule.confidence >= 0.6
        assert sum(hit) >= 0.01 * len(baskets)
    assert any("pills" in token for rule in rules for token in rule.tokens)
    matched = {r.page_id for r in mined_matches(rows, mine(rows, labels, support=0.01, confidence=0.6)).collect()}
    assert matched == {r.page_id for r in rows.collect() if any(set(k.tokens) <= set(r.tokens) for k in rules)}
    verdicts = {r.page_id: r.verdict for r in judge_urls(pages, labels, support=0.01).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    unseen = [i for i in verdicts if i % 2]
    right = sum((verdicts[i] == "block") == bool(re.search("pills|casino", urls[i])) for i in unseen)
    assert right >= 0.95 * len(unseen) and BLOCKED


def test_rules_rest_on_enough_pages_and_more_than_chance(spark):
    rng = random.Random(32)
    pages, labels = [], []
    for i in range(800):
        # One word on 15 bad pages only, one on 40 bad pages, and words that say nothing.
        word = "rare" if i < 15 else "casino" if i < 55 else rng.choice(["news", "blog", "wiki", "shop"])
        bad = i < 55 or rng.random() < 0.4
        pages.append((i, f"https://{word}.site{rng.randrange(6)}.org/p{i}/", None))
        labels.append((i, 0 if bad else 1, 0))
    rows = parsed(spark.createDataFrame(pages, SCHEMA))
    labels = spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' AS tokens", "0 AS bad", "'y' AS token")
    assert [rule.tokens for rule in mine(rows, labels).collect()] == [["h=casino"]]
    assert "h=rare" in {t for rule in mine(rows, labels, pages=10).collect() for t in rule.tokens}
    assert mine(rows, labels.limit(0)).count() == 0 and mine(rows.limit(0), labels).count() == 0


def test_long_urls_that_repeat_are_one_token(spark):
    path = "/".join(f"part-{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    pages = [(i, f"http://host.org/{path}/x" if i % 2 else f"http://other.org/{'a' * 200_000 if i == 0 else 'y'}", None) for i in range(200)]
    labels = [(i, 0 if i % 2 else 1, 0) for i in range(200)]
    pages, labels = spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(labels, LABELS)
    rules = mine(parsed(pages), labels).collect()
    assert len(rules) == 1 and len(rules[0].tokens) == 1 and rules[0].confidence == 1.0
    assert {r.page_id % 2: r.verdict for r in judge_urls(pages, labels).collect()} == {0: "allow", 1: "block"}
