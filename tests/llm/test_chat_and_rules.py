"""Chat formatting from events, decision lists and URL filters."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aneroid.llm import chat_events, chat_template, decision_lists, queries, url_trust

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"
TRICKY = ["\\### Assistant: </turn> ok", "<turn user>\n", "\\", "\\\\<turn", "a\\</turn>\nb", "", None, "<turn", "é\n\n<tur </turn", ">"]


def rendered(spark, messages):
    df = spark.createDataFrame(messages, "conv_id long, position long, role string, text string")
    return {r["conv_id"]: r for r in chat_events.render(df).collect()}


def test_rendering_can_be_read_back(spark):
    rng = random.Random(4)
    messages = [(c, i, rng.choice(["user", "assistant", "a>b\n", None]), rng.choice(TRICKY)) for c in range(60) for i in range(c % 7)]
    got = rendered(spark, messages)
    for c in range(60):
        own = sorted((m for m in messages if m[0] == c), key=lambda m: m[1])
        if not own:
            assert c not in got
            continue
        turns = chat_template.read(got[c]["formatted"])
        assert [(r, t) for r, t, _, _ in turns] == [(r or "", t or "") for _, _, r, t in own]
        assert [(s["start"], s["end"]) for s in got[c]["loss_spans"]] == [(a, b) for r, _, a, b in turns if r == "assistant"]
        assert got[c]["n_turns"] == len(own)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\<>/turn \né", max_size=12), min_size=1, max_size=12))
def test_any_text_survives(spark, texts):
    got = rendered(spark, [(1, i, "assistant", t) for i, t in enumerate(texts)])
    assert [t for _, t, _, _ in chat_template.read(got[1]["formatted"])] == texts


def test_broken_strings_are_rejected():
    for bad in ("x", "<turn user>\nab", "<turn user>\na</turn>\n<turn"):
        with pytest.raises(ValueError):
            chat_template.read(bad)


def folded(spark, events):
    got = chat_events.fold_events(spark.createDataFrame(events, EVENTS)).collect()
    return sorted(((r["conv_id"], r["position"], r["role"], r["text"]) for r in got), key=str)


def test_folding_deltas_edits_and_regenerations(spark):
    events = [
        (1, 5, "delta", 2, None, "lo"), (1, 1, "message", 1, "user", "hi"), (1, 3, "message", 2, "assistant", ""),
        (1, 4, "delta", 2, None, "hel"), (1, 2, "edit", 1, None, "hi there"), (2, 1, "message", 1, "assistant", "no"),
        (2, 2, "delta", 1, None, "!"), (2, 3, "regenerate", 1, None, None), (2, 4, "delta", 1, None, "yes"),
        (2, 4, "delta", 1, None, "yes"), (3, 1, "message", 1, "user", None), (3, 2, "regenerate", 1, "system", None),
        (4, 1, None, 1, "user", "no kind"), (None, None, "message", None, None, "x"), (5, 2, "delta", 9, "user", "late"),
    ]
    expected = [
        (1, 1, "user", "hi there"), (1, 3, "assistant", "hello"), (2, 1, "assistant", "yesyes"), (3, 1, "system", ""),
        (4, 1, "user", "no kind"), (None, None, None, "x"), (5, 2, "user", "late"),
    ]
    shuffled = events[:]
    random.Random(0).shuffle(shuffled)
    assert folded(spark, shuffled) == sorted(expected, key=str)
    assert folded(spark, []) == []


def test_unknown_events_fail(spark):
    with pytest.raises(Exception, match="unknown event"):
        folded(spark, [(1, 1, "delete", 1, "user", "x")])


def test_log_of_finished_turns_folds_back(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "long answer"), (1, 1, "assistant", "long answer"), (2, None, None, None), (1, 2, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_events.fold_events(chat_events.as_log(df)).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [
        (1, "user", "a"), (1, "assistant", "long answer"), (1, "assistant", "long answer"), (1, "assistant", "é"), (2, None, "")
    ]


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_text_statistics_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "a", "a b", "a a a a", "x y z x y z", "l1 #\nl1 #\n\n \nl2", "ü|ß <é>\x0b q"]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 80))) for _ in range(150)] + ["w v " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("old"))
    for r in decision_lists.text_statistics(df).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == statistics(r["text"])


def documents(rng, n):
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 90))]
        kind = i % 6
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w + "##" for w in words]
        rows.append((i, " ".join(words), kind <= 1))
    return rows


def test_learned_rules_find_what_the_labels_mark(spark):
    rows = documents(random.Random(3), 600)
    df = decision_lists.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, bad boolean"))
    rules = decision_lists.learn(df, "bad", "doc_id")
    assert 1 <= len(rules.rules) <= 4
    wrong = df.filter(rules.expression().isNotNull() != F.col("bad")).count()
    assert wrong <= 6
    names = set(decision_lists.features())
    assert all(n in names and s in (">", "<=") for rule in rules.rules for n, s, _ in rule)


def test_every_kind_of_bad_text_is_found(spark):
    """Ten kinds, each with another statistic; half of the shouting texts are good, and no other statistic tells them."""
    names = ["n_words", "word_chars", "n_chars_all", "n_symbols", "n_upper", "n_marks", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words"]
    rng, rows = random.Random(5), []
    change = [
        lambda x: x.update(n_symbols=x["n_words"]), lambda x: x.update(n_digits=2 * x["n_words"]), lambda x: x.update(n_marks=x["n_words"]),
        lambda x: x.update(n_dup_lines=8), lambda x: x.update(n_repeat_words=x["n_words"] // 2), lambda x: x.update(word_chars=12 * x["n_words"]),
        lambda x: x.update(word_chars=2 * x["n_words"]), lambda x: x.update(n_words=20, word_chars=100), lambda x: x.update(n_lines=1),
        lambda x: x.update(n_words=5000, word_chars=25_000, n_lines=250),
    ]
    for i in range(6000):
        n = rng.randrange(180, 220)
        x = dict(zip(names, (n, 5 * n, 6 * n, 0, 0, 0, 0, 10, 0, 0), strict=True))
        kind = i % 60
        if kind < len(change):
            change[kind](x)
        elif kind < 20:
            x["n_upper"] = 4 * n
        rows.append((i, kind, kind < len(change) or kind < 15, *x.values()))
    df = spark.createDataFrame(rows, "doc_id long, kind long, bad boolean, " + ", ".join(f"{c} long" for c in names))
    rules = decision_lists.learn(df, "bad", "doc_id")
    assert len(rules.rules) > 8
    marked = {r["kind"]: r["c"] for r in df.groupBy("kind").agg(F.avg(rules.expression().isNotNull().cast("int")).alias("c")).collect()}
    assert min(marked[k] for k in range(10)) > 0.9 and max(marked[k] for k in range(10, 60)) < 0.1


def test_the_chance_of_a_rule_is_that_of_drawing(spark):
    assert decision_lists._tail(1, 1, 1, 3) == pytest.approx(1 / 4)
    assert decision_lists._tail(2, 2, 3, 7) == pytest.approx(3 / 45)
    assert decision_lists._tail(0, 2, 3, 7) == pytest.approx(1)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_few_labels_give_a_rule(spark, size):
    rows = queries.op3_decision_lists(spark, f"/root/testdata/{size}").collect()
    assert any(r["rule"] is not None for r in rows)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] is None) for r in rows)


def test_nothing_to_learn_gives_no_rules(spark):
    rows = documents(random.Random(3), 40)
    df = decision_lists.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, bad boolean"))
    for one_kind in (df.filter("bad"), df.filter("NOT bad"), df.limit(0), df.withColumn("bad", F.lit(None).cast("boolean"))):
        rules = decision_lists.learn(one_kind, "bad", "doc_id")
        assert rules.rules == [] and df.filter(rules.expression().isNotNull()).count() == 0


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def judged(spark, pages, **kwargs):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r for r in url_trust.judge(df, RULES, **kwargs).collect()}


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("HTTP://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/"),
        2: ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"),
        3: ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
        4: ("x://b.net?/es/", "b.net", "", None), 5: ("http://b.net/es/1", "b.net", "/es/1", "net/es/"),
        6: ("no scheme /en/", "", "", None), 7: (None, "", "", None), 8: ("", "", "", None), 9: ("a://b://c/d", "b:", "//c/d", None),
        10: ("s://ÄB.com/é#x", "Äb.com", "/é", "com/"), 11: ("http://com", "com", "", None), 12: ("http://a.com\n/x", "a.com\n", "/x", None),
    }
    got = judged(spark, [(k, v[0], None) for k, v in urls.items()])
    assert {k: (r["host"], r["path"], r["rule"]) for k, r in got.items()} == {k: v[1:] for k, v in urls.items()}


def test_distrust_follows_links_backwards_and_trust_forwards(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/p">x</a><a href="/own">y</a>' for h in hosts)
    pages = [
        (1, "http://bad.net/es/1", None), (2, "http://fan.org/a", link("bad.net", "BAD.net")), (3, "http://good.com/1", link("liked.org")),
        (4, "http://liked.org/1", ""), (5, "http://alone.org/1", None), (6, "http://bad.net/de/1", ""), (6, "http://bad.net/de/1", ""),
    ]
    got = judged(spark, pages)
    assert {k: r["verdict"] for k, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    assert got[4]["trust"] > 0 and got[2]["distrust"] > 0 and got[5]["trust"] == got[5]["distrust"] == 0


def test_scores_match_power_iteration(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "c", 1), ("d", "a", 3)]
    seeds = {"a": (3, 0), "b": (1, 1), "d": (0, 3)}
    df = url_trust.propagate(
        spark.createDataFrame(edges, "src string, dst string, weight long"),
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, allowed long, blocked long"), rounds=5,
    )
    for kind, k, es in (("trust", 0, edges), ("distrust", 1, [(b, a, w) for a, b, w in edges])):
        seed = {h: s[k] / 4 for h, s in seeds.items()}
        score = dict(seed)
        for _ in range(5):
            new = {h: 0.15 * x for h, x in seed.items()}
            for a, b, w in es:
                new[b] = new.get(b, 0) + 0.85 * score.get(a, 0) * w / sum(e[2] for e in es if e[0] == a)
            score = new
        assert {r["host"]: r[kind] for r in df.collect() if r[kind]} == pytest.approx({h: x for h, x in score.items() if x})


def settled(edges, seeds, damping=0.85):
    """The solution of the linear system that the rounds approach."""
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    passes = np.zeros((len(hosts), len(hosts)))
    for a, b, w in edges:
        passes[at[b], at[a]] += w / sum(e[2] for e in edges if e[0] == a)
    start = np.array([seeds.get(h, 0.0) for h in hosts])
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - damping * passes, (1 - damping) * start)))


@pytest.mark.parametrize("ring", [False, True])
def test_scores_are_settled_however_far_the_links_lead(spark, ring):
    names = [f"h{i:02d}" for i in range(21)]
    edges = [(a, b, 1) for a, b in zip(names, names[1:])] + [("h20", "h00", 1), ("h05", "h17", 2)] * ring
    df = url_trust.propagate(
        spark.createDataFrame(edges, "src string, dst string, weight long"),
        spark.createDataFrame([("h00", 2, 0), ("h20", 0, 1)], "host string, allowed long, blocked long"), tolerance=1e-4,
    )
    got = {r["host"]: r for r in df.collect()}
    assert set(got) == set(names)
    for kind, seed, es in (("trust", "h00", edges), ("distrust", "h20", [(b, a, w) for a, b, w in edges])):
        want = settled(es, {seed: 1.0})
        assert sum(abs(got[h][kind] - want[h]) for h in names) <= 2e-4
        assert all(got[h][kind] > 0 for h in names)


def test_propagation_without_seeds_or_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1)], "src string, dst string, weight long")
    seeds = spark.createDataFrame([("a", 0, 0), ("c", 0, 2)], "host string, allowed long, blocked long")
    assert url_trust.propagate(edges, seeds.limit(0)).collect() == []
    (row,) = url_trust.propagate(edges.limit(0), seeds).collect()
    assert (row["host"], row["trust"], row["distrust"]) == ("c", 0.0, pytest.approx(0.15))
    with pytest.raises(ValueError, match="damping"):
        url_trust.propagate(edges, seeds, damping=1.0)


def test_parent_domains_and_empty_tables(spark):
    pages = [(1, "http://blog.a.org/", None), (2, "http://x.blog.a.org/", None), (3, "http://a.org/", None), (4, "http://b.org/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r["src"], r["dst"]) for r in url_trust.host_links(df).collect()}
    assert got == {("blog.a.org", "a.org"), ("a.org", "blog.a.org"), ("x.blog.a.org", "blog.a.org"), ("blog.a.org", "x.blog.a.org")}
    assert judged(spark, []) == {}
    clash = df.withColumn("host", F.lit("old")).withColumn("verdict", F.lit("old"))
    assert url_trust.judge(clash, RULES).filter("host = 'old' OR verdict = 'old'").count() == 0


def test_without_rules_nothing_is_blocked(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/1", None)], "page_id long, url string, html string")
    row = url_trust.judge(df, []).first()
    assert (row["rule"], row["verdict"], row["trust"], row["distrust"]) == (None, "allow", 0.0, 0.0)
