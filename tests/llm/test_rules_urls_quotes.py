"""Quality rules, URL filter and quotation links against plain versions."""

import re

import duckdb
import pytest

from seqlume.llm import queries, quality_rules, quote_links, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, " \n\t", "one", "one two", "a b c", "a b c a b c d a b c", "a a a a a a", "x | y # z\nx | y # z\n\nx | y # z", "l1\r\nl1\r\nl2\x0b\nü é😀", "the cat " * 40, "spam spam spam " * 30, "the big dog and the small cat are in the house of " * 3000]


def test_measures(spark):
    rows = [(i, t, 1, "w") for i, t in enumerate(TEXTS)] + [(None, "a b", 2, None), (4, "one two", 3, "n_words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, l string")
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(text)
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_rules_are_one_projection(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)


def test_verdicts(spark):
    good = "the people of this town have a house and it is not far from the sea " * 1
    clean = " ".join(f"{good} place{i} word{i} thing{i}" for i in range(8))
    junk = " | ".join(f"wörd{i} #" for i in range(80))
    docs = spark.createDataFrame([(1, clean), (2, junk), (3, "too short"), (4, None)], "doc_id long, text string")
    own = (("n_words", 10, None), ("symbol_ratio", None, 0.1))
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, own).collect()}
    assert [got[i]["passed"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[2]["fails_symbol_ratio"] and not got[1]["fails_symbol_ratio"] and not got[4]["fails_symbol_ratio"]


def plain_url(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or (len(rule), len(h)) > (len(best[0]), len(best[0].partition("/")[0])):
                best = (rule, verdict)
    return (host, path, *(best or (None, "allow")))


URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/1?x", "https://example.net", "https://example.net/", "http://xnet/en/", "http://a.b.example.com/de/7#t", "http://example.org/fr/://x", "http://org/fr/", "ftp://a..net/x", "http://net?x=1", "http://ÉX.net/ü", "http://example.com/DE/", "http://a\nb.net/x\ny", "http://example.net/en"]


def test_urls(spark):
    rules = [*queries.URL_RULES, ("a.b.example.com/de", "allow"), ("example.com/de/7", "block")]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(None, URLS[4], None, 2)], "page_id long, url string, host string, rule int")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[4] if r["page_id"] is None else URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_url(url, rules), url
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, [], default="block").collect()} == {"block"}


def test_rule_files(tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        url_filter.write_rules([("no-path", "block")], str(tmp_path / "r"))
    with pytest.raises(ValueError):
        url_filter.write_rules([("a/", "block"), ("a/", "allow")], str(tmp_path / "r"))
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))  # collisions everywhere
    url_filter.write_rules([("ab.c/", "block"), ("xy.z/", "allow"), ("ab.c/", "block")], str(tmp_path / "r"))
    rules = url_filter.Rules(str(tmp_path / "r"))
    assert rules.match(["ab.c", "xy.z", "qq.q", ""], ["/", "/x", "/", ""]) == (["ab.c/", "xy.z/", None, None], ["block", "allow", None, None])


CHAT = [
    (1, 0, "user", "Where is the station?\nI need a train.\n\nThanks a lot!"),
    (1, 1, "assistant", "> Where is the station?\nIt is behind the park."),
    (1, 2, "user", "> > where is  THE station\n> It is behind the park.\nAnd the bus?"),
    (1, 3, "assistant", ">Thanks a lot!\nYou are welcome.\n> never said by anyone"),
    (1, 4, "user", "no quotes here"),
    (2, None, "user", None),
    (2, 7, "assistant", ">>> deep quote of nothing"),
    (None, 1, "user", "Where is the station?"),
    (1, 4, "user", "no quotes here"),
]


def test_quotes(spark):
    messages = spark.createDataFrame([(*r, 5, "x") for r in CHAT], "conv_id long, turn long, role string, text string, position int, lines string")
    got = quote_links.link_quotes(messages).collect()
    assert len(got) == len(CHAT)
    one = {(r["conv_id"], r["position"]): r for r in got}
    assert one[1, 0]["reply_to"] is None and one[1, 0]["text"] == CHAT[0][3]
    assert (one[1, 1]["reply_to"], one[1, 1]["linked"], one[1, 1]["text"]) == (0, True, "It is behind the park.")
    assert (one[1, 2]["reply_to"], one[1, 2]["quote_level"], one[1, 2]["n_passages"], one[1, 2]["n_linked"]) == (1, 2, 2, 2)
    assert (one[1, 3]["reply_to"], one[1, 3]["n_passages"], one[1, 3]["n_linked"], one[1, 3]["text"]) == (0, 2, 1, "You are welcome.")
    assert (one[1, 4]["reply_to"], one[1, 4]["linked"]) == (3, False) and (1, 5) in one
    assert (one[2, 1]["reply_to"], one[2, 1]["linked"], one[2, 1]["quote_level"], one[2, 1]["text"]) == (0, False, 3, "")
    assert one[None, 0]["reply_to"] is None
    assert quote_links.link_quotes(messages.limit(0)).count() == 0


def test_quotes_stay_in_spark(spark):
    messages = spark.createDataFrame([CHAT[0]], "conv_id long, turn long, role string, text string")
    assert not re.search("Python|Arrow|Pandas", quote_links.link_quotes(messages)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
