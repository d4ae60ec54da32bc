"""The walks over JSON payloads and html against recursive and scalar second readers, deep, long and broken input."""

from __future__ import annotations

import json
import random
import re
import time
from html import unescape

from dossier.functions import text
from dossier.operators import blocks, json_walk, structured

SF = "/root/testdata/sf0.001"


def paths(v, at="$"):
    if isinstance(v, dict):
        return [x for k in v for x in paths(v[k], f"{at}.{k}")] or [at]
    if isinstance(v, list):
        return [x for i, e in enumerate(v) for x in paths(e, f"{at}[{i}]")] or [at]
    return [at]


def is_secret(key):
    return any(word in key.lower() for word in text.SENSITIVE)


def masked(v):
    return {k: "[REDACTED]" if is_secret(k) else masked(x) for k, x in v.items()} if isinstance(v, dict) else v


def leaves(v, at="$"):
    if isinstance(v, dict) and v:
        return [x for k, e in v.items() for x in ([(f"{at}.{k}", "[REDACTED]")] if is_secret(k) else leaves(e, f"{at}.{k}"))]
    return [(at, v)]


def objects(v, at="$"):
    if isinstance(v, dict):
        return [(at, v)] + [x for k in v for x in objects(v[k], f"{at}.{k}")]
    return [x for i, e in enumerate(v) for x in objects(e, f"{at}[{i}]")] if isinstance(v, list) else []


def shallow(v, n):
    if isinstance(v, dict | list) and not n:
        return None
    return {k: shallow(x, n - 1) for k, x in v.items()} if isinstance(v, dict) else [shallow(x, n - 1) for x in v] if isinstance(v, list) else v


def payload(rng, depth=0):
    r = rng.random()
    if depth > 12 or r < 0.25:
        return rng.choice([1, -2.5e3, 'x, {y} [z] "q\\', None, True, "", {}, []])
    if r < 0.75:
        return {rng.choice(["a", "b c", "Pass_token", 'é"k', "@type", "x.y", "secret"]) + str(i): payload(rng, depth + 1) for i in range(rng.randrange(4))}
    return [payload(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_walks_equal_recursive_ones():
    rng = random.Random(2)
    for n in range(1500):
        v = payload(rng)
        raw = json.dumps(v, ensure_ascii=bool(n % 2), indent=None if n % 3 else 1)
        assert sorted(p for p, _, _ in json_walk.leaves_of(raw)) == sorted(paths(v))
        whole, found = json_walk.redacted_of(raw)
        assert json.loads(whole) == masked(v)
        plain = lambda rows: sorted((p, json.dumps(x)) for p, x in rows)
        assert plain((p, "[REDACTED]" if x is None else json.loads(x)) for p, x in found) == plain(leaves(v))
        assert plain((p, json.loads(x)) for p, _, x in json_walk.objects_of(raw)) == plain((p, shallow(o, json_walk.SHOWN)) for p, o in objects(v))


def nested(levels, inner):
    return '{"k":' * levels + inner + "}" * levels


def test_secrets_and_leaves_below_any_number_of_levels(spark):
    deep = [nested(n, '{"password":"hidden","plain":1}') for n in (9, 50, 400)]
    df = spark.createDataFrame([*enumerate(deep), (3, "{broken"), (4, None), (5, '[{"token":"kept"}]'), (6, '"text"')], "i int, m string")
    whole = {r["i"]: r["m"] for r in json_walk.redacted_rows(df, ["i"], "m").collect()}
    assert whole == {k: nested(n, '{"password":"[REDACTED]","plain":1}') for k, n in enumerate((9, 50, 400))} | {3: '"[REDACTED]"', 4: None, 5: '[{"token":"kept"}]', 6: '"text"'}
    rows = json_walk.redacted_paths(df, ["i"], "m").collect()
    assert len(rows) == 8 and not any("hidden" in r["value"] for r in rows)
    assert {(r["i"], r["path"]) for r in json_walk.json_paths(df.where("i < 3"), ["i"], "m").collect()} == {(k, "$" + ".k" * n + leaf) for k, n in enumerate((9, 50, 400)) for leaf in (".password", ".plain")}


def test_facts_of_deep_objects(spark):
    own = '{"@type":"Corporation","name":"Deep Co","address":{"streetAddress":"1 Road","addressCountry":"VN"},"employee":[{"name":"B","jobTitle":"CEO"}]}'
    df = spark.createDataFrame([(1, nested(30, own))], "i int, text_content string")
    got = {r["field_key"]: r["value"] for r in structured.structured_facts(df, ["i"]).collect()}
    assert got == {"identity.legal_name": '"Deep Co"', "identity.address": '"1 Road, VN"', "identity.country": '"VN"', "leadership.board_members": '[{"name":"B","role":"CEO"}]'}


TAG = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^>]*)?)>", re.S)


def second_reader(html):
    """(tag, text) and (href, label) as elements close, by splitting the page at its tags; for pages without odd markup."""
    pieces, opened, elements, links, at, raw = [], [], [], [], 0, None
    for m in TAG.finditer(html):
        if raw and not (m[1] and m[2] == raw):
            continue
        if html[at : m.start()]:
            pieces.append(html[at : m.start()] if raw else unescape(html[at : m.start()]))
        at, raw = m.end(), None
        if not m[2]:
            continue
        if not m[1]:
            opened.append((m[2], m[3], len(pieces)))
            raw = m[2] if m[2] in ("script", "style") else None
        elif any(tag == m[2] for tag, *_ in opened):
            while True:
                tag, attributes, start = opened.pop()
                if tag == m[2]:
                    break
            own = pieces[start:]
            if tag in blocks.ELEMENTS and " ".join(" ".join(own).split()):
                elements.append((tag, " ".join(" ".join(own).split())))
            if tag == "a" and (href := re.search(r'href="([^"]*)"', attributes)):
                links.append((href[1], " ".join("".join(own).split())))
    return elements, links


def test_pages_against_a_second_reader(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert len(pages) == 50
    for html in pages:
        rows = blocks.frames_of(html)
        assert ([(r[1], r[2]) for r in rows if r[0] == "element"], [(r[3], r[2]) for r in rows if r[0] == "link"]) == second_reader(html)


def test_void_tags_take_time_in_proportion():
    began = time.time()
    rows = blocks.frames_of("<div><p>" + "word<br><img src=x>" * 100_000 + "</p></div>")
    assert time.time() - began < 20 and rows[0][2] == " ".join(["word"] * 100_000)


def test_metadata_location_and_language(spark):
    html = '<html><head><title>T</title><meta name="d" content="D"><meta property="og:title" content="O"><script type="application/ld+json">{"b":[{"c":1}],"a":{}}</script></head><body><h2>H</h2><p>a</p><p>b</p><a href="/x">L</a></body></html>'
    rows = [(1, "https://e.vn/p", html, "VI_vn"), (2, "https://e.vn/q", "only words of a company", None), (3, "https://e.vn/r", '<meta name="n" content="headquarters">', ""), (4, None, html.replace("<html>", '<html lang="fr">'), None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, said string")
    got = {(r["page_id"], r["block_key"]): r for r in blocks.html_blocks(df, language="said").collect()}
    at = lambda *k: (json.loads(got[k]["location"]), json.loads(got[k]["metadata"]))
    source = "https://e.vn/p"
    assert at(1, "json_ld_0001_0001") == ({"kind": "json-ld", "script_ordinal": 1}, {"format": "json-ld", "field_paths": ["$.a", "$.b[0].c"], "provenance": {"source_url": source, "evidence_location": "script[type=application/ld+json][1]"}})
    assert at(1, "meta_0002") == ({"kind": "meta", "ordinal": 2}, {"kind": "opengraph", "name": "og:title", "content": "O"}) and at(1, "title_0001") == ({"tag": "title", "ordinal": 1}, {"kind": "document_title"})
    assert at(1, "h2_0001")[1] == {"level": 2} and at(1, "paragraph_0002") == ({"tag": "p", "ordinal": 2}, {}) and at(2, "paragraph_0001")[0] == {"kind": "plain-text-fallback", "ordinal": 1}
    assert at(1, "link_0001") == ({"tag": "a", "ordinal": 1}, {"href": "https://e.vn/x", "label": "L", "source_url": source})
    assert {k[0]: r["language"] for k, r in got.items()} == {1: "vi-vn", 2: "en", 3: "en", 4: "fr"}
