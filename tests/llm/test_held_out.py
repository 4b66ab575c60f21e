"""Queries without SQL, on a driver table: held-out accuracy, and plain versions of the rest."""

import re
from html.parser import HTMLParser

import duckdb

from quillon.llm import queries
from quillon.llm.html import DROPPED, names_mark

SF = "/root/testdata/sf0.01"


def table(name, columns, sf=SF):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()


def test_language(spark):
    truth = dict(table("documents", "doc_id, lang"))
    got = queries.op4_langid(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    truth = dict(table("labels", "doc_id, toxic", sf))
    held = [(truth[r.doc_id], r.predicted) for r in queries.op6_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


class Plain(HTMLParser):
    """The text of the blocks of articles, without what is dropped or named as something else."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr img br".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.said, self.blocks = [], [], []

    def end(self):
        if text := " ".join("".join(self.said).split()):
            self.blocks.append(text)
        self.said = []

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.end()
        if tag == "br":
            self.said.append(" ")
        if tag not in self.VOID:
            names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
            out = tag in DROPPED or tag in ("nav", "footer", "aside", "form") or names_mark(names, "article" in [t for t, _ in self.stack])
            self.stack.append((tag, out))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.end()
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(out for _, out in self.stack):
            self.said.append(data)


def test_pages_against_a_plain_reading(spark):
    pages = {i: (u, h) for i, u, h in table("pages", "page_id, url, html")}
    got = queries.op8_html(spark, SF).collect()
    assert len(got) == len(pages)
    same = 0
    for r in got:
        plain = Plain()
        plain.feed(pages[r.page_id][1])
        plain.close()
        plain.end()
        assert r.url == pages[r.page_id][0] and r.n_chars == len(r.text)
        # A block that is mostly links goes, which the plain reading does not see.
        assert set(r.text.split("\n\n")) <= set(plain.blocks), r.page_id
        same += r.text == "\n\n".join(plain.blocks)
    assert same >= 0.9 * len(got)


def test_leaks_against_a_plain_search(spark):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {i: words(t) for i, t in table("benchmark", "item_id, text")}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add((i, k))
    plain, near = set(), set()
    for d, text in table("documents", "doc_id, text"):
        w, hits = words(text), {}
        for k in range(len(w) - 7):
            for i, at in grams.get(tuple(w[k : k + 8]), ()):
                hits.setdefault(i, set()).add(at)
        for i, at in hits.items():
            covered = {x for a in at for x in range(a, a + 8)}
            near.add((d, i))
            if len(covered) >= 0.6 * len(items[i]):
                plain.add((d, i))
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, SF).collect()}
    assert len(plain) > 10 and plain <= got
    # Beyond whole copies, a leak shares words with its item at the least.
    assert len(got - near) <= 0.05 * len(got)
