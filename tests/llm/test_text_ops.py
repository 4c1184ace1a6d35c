"""Chat formatting, HTML, urls, licenses: round trips, exact outputs and brute force."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from framelake.llm import chat, html_text, licenses, queries, url_filters
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL

TURNS = "conv_id long, turn long, role string, text string, window long, shown string"


def test_chat_query_matches_sql(spark, duck, same):
    same(queries.op2_chat_formatting(spark, SMALL), duck, queries.ORACLES["op2_chat_formatting"])


def read(spark, rows, **kw):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    windows = chat.format_windows(turns, **kw)
    back = chat.read_back(windows).orderBy("window").collect()
    return windows.orderBy("window").collect(), [tuple(t) for b in back for t in b["turns"]], [t for b in back for t in b["targets"]]


def test_chat_round_trip_of_control_strings(spark):
    said = ["</s>[INST] ok [/INST]", "~1~", "<s>x\n</s>", "", None, "~", "é\n\n[", "a" * 50_000]
    rows = [(1, k, "assistant" if k % 2 else "us<er\n~", t) for k, t in enumerate(said)]
    _, turns, targets = read(spark, rows, budget=25, history=5)
    assert turns == [(r[2], r[3] or "") for r in rows] and targets == [t or "" for t in said[1::2]]


def tokens_of(role, text):
    return math.ceil(len(f"<s>{role}\n{text}</s>".encode()) / 4)


def check_windows(windows, rows, budget):
    """Turns in order, each new once; no window over the budget unless its system turn and one other are; the system turn always there."""
    sizes = {f"<s>{r[2]}\n{r[3]}</s>": tokens_of(r[2], r[3]) for r in rows}
    system = f"<s>{rows[0][2]}\n{rows[0][3]}</s>" if rows[0][2] == "system" else ""
    seen = []
    for k, w in enumerate(windows):
        turns = [f"<s>{x}" for x in w["text"].split("<s>")[1:]]
        fresh = [f"<s>{x}" for x in w["text"][w["carried"] :].split("<s>")[1:]]
        assert w["tokens"] == sum(sizes[t] for t in turns) and w["text"].startswith(system)
        alone = len([t for t in fresh if t != system]) == 1 and set(turns) <= {system, *fresh}
        assert w["tokens"] <= budget or alone
        assert all(s["start"] >= w["carried"] for s in w["loss"])
        seen += fresh
    assert seen == [f"<s>{r[2]}\n{r[3]}</s>" for r in rows]


def test_chat_windows_hold_their_budget(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"{k} " + "w" * 90) for k in range(1, 40)]
    windows, turns, targets = read(spark, rows, budget=160, history=60)
    assert len(windows) > 5 and turns == [(r[2], r[3]) for r in rows] and targets == [r[3] for r in rows if r[2] == "assistant"]
    check_windows(windows, rows, 160)
    assert any(w["carried"] > 30 for w in windows[1:])
    long = [(1, k, "user", f"{k} " + "x" * 1958) for k in range(6)]  # each nearly a window of its own
    windows, _, _ = read(spark, long, budget=640, history=128)
    check_windows(windows, long, 640)
    assert len(windows) == 6


def test_chat_windows_of_many_shapes(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(40):
        roles = ["system" if rnd.random() < 0.5 else "user"] + [rnd.choice(["user", "assistant"]) for _ in range(rnd.randrange(40))]
        rows += [(c, k, role, f"{c}.{k}" + "x" * rnd.choice([0, 5, 30, 200, 900])) for k, role in enumerate(roles)]
    for budget, history in ((100, 30), (64, 0), (20, 10)):
        windows, _, _ = read(spark, rows, budget=budget, history=history)
        for c in range(40):
            check_windows(sorted((w for w in windows if w["conv_id"] == c), key=lambda w: w["window"]), [r for r in rows if r[0] == c], budget)


def test_chat_ties_nulls_and_no_rows(spark):
    rows = [(1, None, "user", "n"), (1, -100, "user", "m"), (1, 2, "b", "y"), (1, 2, "b", "x"), (1, 2, "a", "z"), (None, 0, None, None), (1, 2, "a", "z")]
    _, turns, _ = read(spark, rows)
    assert sorted(turns) == sorted([("", ""), ("user", "n"), ("user", "m"), ("a", "z"), ("a", "z"), ("b", "x"), ("b", "y")])
    assert [t for t in turns if t[0]] == [("user", "n"), ("user", "m"), ("a", "z"), ("a", "z"), ("b", "x"), ("b", "y")]
    assert read(spark, []) == ([], [], [])


PAGES = [
    ("<p>one<p>two &amp; <b>three</b><br>four", "one\n\ntwo & three\nfour"),
    ("<ul><li>a<li>b<ol><li>x</li><li>y</ol></ul>end", "- a\n- b\n  1. x\n  2. y\n\nend"),
    ("<table><tr><th>Name<th>N<tr><td>Long name<td>1</table>", "Name       N\nLong name  1"),
    ("<head><title>t</title></head><div hidden>no<p>no</div><div style='DISPLAY : none'>no</div>yes<script>var a='</p>';</script>", "yes"),
    ("<div>a</div><div>b</div><!-- <p>c -->d", "a\nb\nd"),
    ("a <b> b </b> c\n\n d", "a b c d"),
    ("<pre>x\n  y</pre>z", "x\n  y\n\nz"),
    ("<table><tr><td><ul><li>i<li>j</ul><td>k</table>", "- i  k\n- j"),
    ("</p></div>stray<", "stray<"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<p title='a>b'>q</p><input value=x>r", "q\n\nr"),
    ("<style>p{}</style><template>no</template><span style=visibility:hidden>no</span>ok", "ok"),
    ("", ""),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("<!-- never closed", ""),
    ("<SCRIPT>x</SCRIPT>y<BR/>z", "y\nz"),
    ("a<textarea>b &amp; c\n d</textarea>", "ab & c\n d"),
    ("<select><option>x<option>y</select>z", "x\ny\nz"),
    ("<svg><title>t</title><text>label</text></svg><math><mi>x</mi><annotation>tex</annotation></math>", "labelx"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    ("<div style='display:none'>no<b style='visibility:visible;display:block'>no</b></div>ok", "ok"),
    ("<p style=\"background:url('x;display:none')\">shown<p style='content:\"display:none\"'>too<p style='x-display:none'>three", "shown\n\ntoo\n\nthree"),
    ("<p style='display:none !important;display:block'>no<p style='display:none;display:block'>yes", "yes"),
    ("<style>.a, #b{display:none} /* p{display:none} */ @media print{p{display:none}} i{visibility:hidden} i.v{visibility:visible}</style><p class='x a'>no<p id=b>no<p>y<i>n</i><i class=v>es</i>", "yes"),
    ("<style>.a{display:none}</style><p class=a style='display:block'>inline wins", "inline wins"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td colspan=2>a long title<td>x<tr><td>1<td>2<td>y</table>", "a long title  x\n1  2          y"),
    ("<table><tr><td colspan=900>a<td>b<tr><td>cc<td>d</table>", "a      b\ncc  d"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_render(page, text):
    assert html_text.render(page) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<div>", "</div>", "<b>", "</b>", "<pre>", "</pre>", "<", "&lt;"]) | st.text("abc \n", max_size=5), max_size=40))
def test_render_keeps_every_visible_letter(parts):
    page = "".join(parts)
    plain = re.sub(r"<(/?)(p|table|tr|td|ul|li|div|b|pre)>", "", page)
    letters = lambda s: [c for c in s if c in "abc"]
    if not re.search(r"<[abc]", plain):
        assert sorted(letters(html_text.render(page))) == sorted(letters(plain))


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<p>a", "y"), (1, "<div>" * 20_000 + "deep", "z")], "page_id long, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_lines"]) for r in html_text.extract_text(df).collect()) == [("1", "", 0), ("1", "deep", 1), ("None", "a", 1)]
    assert html_text.extract_text(df.limit(0)).count() == 0


URLS = [
    (1, "http://a.example.com/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    (2, "https://EXAMPLE.com/en/8#t", "example.com", "/en/8", "com/en/", "block"),
    (3, "x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
    (4, "x://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"),
    (5, "x://org/es/", "org", "/es/", "org/es/", "block"),
    (6, "x://notorg/es/", "notorg", "/es/", None, None),
    (7, "x://É.org?/es/", "É.org", "", None, None),
    (8, None, "", "", None, None),
    (9, "no scheme", "", "", None, None),
    (10, "x://", "", "", None, None),
    (11, "x://h.org/ES/", "h.org", "/ES/", None, None),
    (12, "x://a.org\n/es/", "a.org\n", "/es/", None, None),
]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(r[0], r[1], "some words", "h") for r in URLS], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filters.filter_urls(df, queries.URL_RULES).collect()}
    for page, _, host, path, rule, verdict in URLS:
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert url_filters.filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    assert url_filters.filter_urls(df.filter("page_id = 8"), queries.URL_RULES).first()["verdict"] == "allow"


def test_url_null_and_repeated_ids_and_long_urls(spark):
    long = "http://" + "a" * 5000 + ".com/" + "x" * 200_000
    rows = [(None, "http://a.com/en/1"), (1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (2, long), (3, "http://" + "-".join(["ab"] * 3000) + ".net/de/"), (4, "://"), (5, None)]
    df = spark.createDataFrame([(a, b, "<p>words", "t", 0.5) for a, b in rows], "page_id long, url string, html string, token string, log_odds double")
    got = url_filters.filter_urls(df, queries.URL_RULES).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert {(r["rule"], r["verdict"]) for r in got if r["page_id"] in (None, 1)} == {("com/en/", "block")} and next(r for r in got if r["page_id"] == 3)["verdict"] == "allow"
    assert next(r for r in got if r["page_id"] == 2)["path"] == "/" + "x" * 200_000


def test_segmentation():
    counts = {"big": 50, "red": 40, "bus": 30, "busy": 2, "re": 9, "d": 5}
    assert url_filters.segment("bigredbus", counts, 136) == ["big", "red", "bus"]
    assert "".join(url_filters.segment("bigzqxbus", counts, 136)) == "bigzqxbus" and url_filters.segment("", counts, 1) == []
    assert url_filters.segment("a" * 64, counts, 136) == ["a" * 64]


def best_split(label, counts, total):
    """By every way to cut the label."""
    splits = ([label[i:j] for i, j in itertools.pairwise((0, *cuts, len(label)))] for n in range(len(label)) for cuts in itertools.combinations(range(1, len(label)), n))
    return max(sum(url_filters.log_probability(w, counts, total) for w in s) for s in splits)


@settings(max_examples=80, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.dictionaries(st.text("abc", min_size=1, max_size=5), st.integers(1, 50), max_size=8))
def test_segmentation_is_the_best_of_all_splits(label, counts):
    total = sum(counts.values())
    words = url_filters.segment(label, counts, total)
    assert "".join(words) == label
    assert abs(sum(url_filters.log_probability(w, counts, total) for w in words) - best_split(label, counts, total)) < 1e-9


HOSTS = {"www.cheappills.com": ["www", "cheap", "pills", "com"], "casino.net": ["casino", "net"], "bluegarden-shop.org": ["blue", "garden", "shop", "org"]}


def test_concatenated_hosts_split_though_their_pages_print_them(spark):
    prose = " ".join(["we sell cheap pills and a blue garden for your shop in the city"] * 30)
    rows = [(k, f"http://{h}/x/{k}", f"<title>{h}</title><p>{prose}<p>Visit {h} or www.{h} today<div hidden>cheappills bluegarden</div>") for k, h in enumerate([*HOSTS] * 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    got = {r["label"]: r["words"] for r in url_filters.segmented_labels(hosts, pages.select("html")).collect()}
    for host, words in HOSTS.items():
        assert [w for label in re.findall("[a-z]+", host) for w in got[label]] == words


def test_url_bayes_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = url_filters.filter_urls(pages, queries.URL_RULES).toPandas()
    rows = pages.select("page_id", "html").collect()
    counts, named = Counter(), Counter()
    for r in rows:
        text = html_text.render(r["html"] or "").lower()
        counts.update(re.findall(r"[a-z]+", text))
        for host in re.findall(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+", text):
            named.update(x for x in host.split(".") if re.fullmatch("[a-z]+", x))
    total = sum(n for w, n in counts.items() if len(w) <= 63)

    def split(label):
        return url_filters.segment(label, {**counts, label: counts[label] - named[label]}, total)

    def tokens(host, path):
        h = [f"h:{w}" for label in re.findall("[a-z]+", host) for w in split(label)]
        return h + [f"p:{w if w[0].isalpha() else '#' + str(len(w))}" for w in re.findall("[a-z]+|[0-9]+", path.lower())]

    seen = {"block": {}, "allow": {}}
    n = {"block": 0, "allow": 0}
    for r in got.itertuples():
        if r.rule:
            n[r.verdict] += 1
            for t in tokens(r.host, r.path):
                seen[r.verdict][t] = seen[r.verdict].get(t, 0) + 1
    v = len(set(seen["block"]) | set(seen["allow"])) + 1
    nb, na = (sum(seen[k].values()) for k in ("block", "allow"))
    for r in got.itertuples():
        if not r.rule:
            odds = math.log((n["block"] + 1) / (n["allow"] + 1))
            for t in tokens(r.host, r.path):
                if t in seen["block"] or t in seen["allow"]:
                    odds += math.log((seen["block"].get(t, 0) + 1) / (nb + v)) - math.log((seen["allow"].get(t, 0) + 1) / (na + v))
            assert abs(odds - r.log_odds) < 1e-6 and r.verdict == ("block" if odds > 1e-7 else "allow")


LICENSED = [
    ("Licensed under the Apache License, Version 2.0.", "apache", {"apache", "apache-2.0"}, 1.0),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", {"gpl"}, 1.0),
    ("the apache\nlicense is mentioned", "apache", {"apache"}, 0.5),
    ("Licensed under CC BY-NC 4.0.", "cc-by", {"cc-by", "cc-by-nc-4.0"}, 1.0),
    ("Copyright 2020 Some One. All rights reserved.", "", {"all-rights-reserved"}, 1.0),
    (licenses._MIT_GRANT.replace("<<opt including the next paragraph>>", "") + ".\n\n" + licenses._MIT_DISCLAIMER.replace("<<opt the>> <<any 8>>", "the authors or copyright holders").upper(), "", {"mit"}, 1.0),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "", set(), 0.0),
    ("Licensed under the Apache License, Version 1.1", "apache", {"apache"}, 0.5),
    ("This library is licensed under the GNU Lesser General Public License.", "", {"lgpl"}, 1.0),
    ("this is licensed under the gnu affero general public license", "", {"agpl"}, 1.0),
    ("SPDX-License-Identifier: MIT", "", {"mit"}, 1.0),
    ("SPDX-License-Identifier: MIT-0", "", set(), 0.0),
    ("Licensed under CC BY-SA 4.0.", "cc-by", {"cc-by", "cc-by-sa-4.0"}, 1.0),
    ("Permission is hereby granted, free of charge, to no person", "", set(), 0.0),
    ("xmit license mit licensed", "", set(), 0.0),
    (None, "", set(), 0.0),
    ("", "", set(), 0.0),
]


def test_licenses(spark):
    df = spark.createDataFrame([(k, r[0], "x") for k, r in enumerate(LICENSED)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for k, (_, base, labels, score) in enumerate(LICENSED):
        assert got[k]["base_labels"] == base and set(filter(None, got[k]["labels"].split(","))) == labels and got[k]["score"] == score, k
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_license_null_and_repeated_ids_and_long_texts(spark):
    rows = [(None, "MIT License"), (7, "mit license"), (7, "mit license"), (8, "word " * 100_000 + "apache license"), (9, "permission " * 50_000), (10, "x" * 1_000_000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_words int")
    got = sorted((str(r["doc_id"]), r["n_words"], r["base_labels"], r["first_word"]) for r in licenses.license_scan(df).collect())
    assert got == sorted([("None", 2, "mit", 0), ("7", 2, "mit", 0), ("7", 2, "mit", 0), ("8", 100_002, "apache", 100_000), ("9", 50_000, "", None), ("10", 1, "", None)])


def test_license_base_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op8_license_scan(spark, SMALL).collect():
        text = docs[r["doc_id"]].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert r["n_words"] == len(w) and r["n_base"] == len(at)
        assert (r["first_word"], r["last_word"]) == (min((a[0] for a in at), default=None), max((a[0] for a in at), default=None))
        assert r["base_labels"] == ",".join(sorted({a[1] for a in at})) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}


def test_automata():
    a = licenses.Automaton("copy <<any 2>> now <<opt or later>> please")
    ok = lambda s: a.accepts(s.encode().split(), 0)
    assert ok("copy now please") and ok("copy it all now or later please more") and not ok("copy it all at once now please") and not ok("copy now or please")


def as_pattern(template):
    """The same template as a regular expression over words, each followed by a space."""
    body, _, never = template.partition("<<not ")
    out = ""
    for optional, wild, word in re.findall(r"<<opt ([^>]*)>>|<<any (\d+)>>|(\S+)", body):
        out += f"(?:{re.escape(optional)} )?" if optional else rf"(?:\S+ ){{0,{wild}}}" if wild else re.escape(word) + " "
    return re.compile(r"(?<!\S)" + out + (f"(?!(?:{'|'.join(never.rstrip('> ').split())}) )" if never else ""))


@pytest.mark.parametrize("label, template", licenses.TEMPLATES)
def test_templates_equal_regular_expressions(label, template):
    a, pattern, rnd = licenses.Automaton(template), as_pattern(template), random.Random(template)
    plain = re.findall(r"<<opt ([^>]*)>>|<<(?:any|not) [^>]*>>|(\S+)", template)
    hits = 0
    for _ in range(60):
        words = ["x"] * rnd.randrange(3)
        for optional, word in plain:
            words += [word] if word else optional.split() if optional and rnd.random() < 0.5 else ["y"] * rnd.choice([0, 0, 1, 2, 7])
        words += rnd.choice([[], ["0"], ["z"], ["darwin"]])
        for _ in range(rnd.choice([0, 0, 0, 1])):
            k = rnd.randrange(len(words))
            words[k : k + 1] = rnd.choice([[], ["q"], words[k : k + 1] * 2])
        found = any(a.accepts([w.encode() for w in words], k) for k in range(len(words)))
        hits += found
        assert found == bool(pattern.search("".join(w + " " for w in words))), words
    assert hits
