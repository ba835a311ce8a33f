"""Registered queries that SQL can't express, against versions in plain Python over the whole smallest tables."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import duckdb
import numpy as np
import pytest

from docloom import schemas as S
from docloom.functions import text as tx
from docloom.functions.fuzzy import align, indel_ratio
from docloom.functions.keywords import keywords
from docloom.functions.sentences import split_sentences
from docloom.operators.cite import nearest_whitespace, snippet
from docloom.operators.combine import combine_texts
from docloom.operators.enrich import key_sentences
from docloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def rows_of(small_tables):
    return lambda sql: duckdb.sql(re.sub(r"FROM (\w+)", rf"FROM '{small_tables}/\1.parquet'", sql)).fetchall()


@pytest.fixture(scope="module")
def docs(rows_of):
    return dict(rows_of("SELECT doc_id, text FROM documents"))


@pytest.fixture(scope="module")
def passages(rows_of):
    return dict(rows_of("SELECT item_id, text FROM benchmark"))


@pytest.fixture
def got(spark, small_tables):
    return lambda name: [r.asDict(recursive=True) for r in QUERIES[name](spark, small_tables).collect()]


def kind_of(line):
    line = line.strip(" ")
    if re.search(r" \| .* \|", line):
        return S.TABLE
    if re.match(r"[-*•] |[0-9]+[.)] ", line):
        return S.LIST_ITEM
    return S.TITLE if len(line) <= 60 and line[-1] not in ".!?:;," else S.NARRATIVE


def nodes_of(doc_id, text):
    """Lines as nodes: dicts in reading order."""
    out, title = [], None
    for seq, line in enumerate(text.split("\n")):
        if not line.strip(" "):
            continue
        kind, node_id = kind_of(line), f"{doc_id}:{seq}"
        out.append({"doc_id": doc_id, "seq": seq, "node_id": node_id, "type": kind, "parent_id": None if kind == S.TITLE else title, "text": line, "page": seq // 20 + 1})
        title = node_id if kind == S.TITLE else title
    return out


@pytest.fixture(scope="module")
def nodes(docs):
    return {d: nodes_of(d, t) for d, t in docs.items() if t is not None}


def fold_kind(a, b):
    if a == b:
        return a
    if a in S.TEXT_KINDS and b in S.TEXT_KINDS:
        return S.TEXT_COMPOSITE
    return S.IMAGE if a in S.IMAGE_KINDS and b in S.IMAGE_KINDS else S.COMPOSITE


def fold(members, keep="one_kept"):
    text, kind = members[0]["text"], members[0]["type"]
    for m in members[1:]:
        text, kind = combine_texts(text, m["text"], keep), fold_kind(kind, m["type"])
    return kind, text


def merge_runs(rows, kind, last):
    out, moved = [], {}
    for is_kind, run in groupby(rows, lambda r: r["type"] == kind):
        run = list(run)
        for part in [run] if is_kind else [[r] for r in run]:
            survivor = part[-1 if last else 0]
            folded_kind, text = fold(part)
            moved |= {m["node_id"]: survivor["node_id"] for m in part} if len(part) > 1 else {}
            out.append(survivor | {"seq": part[0]["seq"], "type": folded_kind, "text": text})
    return [r | {"parent_id": moved.get(r["parent_id"], r["parent_id"])} for r in out]


def key(rows, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


def test_merged_runs(got, nodes):
    truth = [r for rows in nodes.values() for r in merge_runs(merge_runs(rows, S.TITLE, True), S.LIST_ITEM, False)]
    columns = ("doc_id", "seq", "node_id", "type", "parent_id", "text")
    assert key(got("merged_runs"), *columns) == key(truth, *columns)


def sections(rows):
    """The procedure, node by node: what is open takes what comes."""
    emitted, members, anchors, first = [], {}, {}, True
    for r in rows:
        newline = r["text"] + "\n"
        if r["type"] in (S.HEADER, S.FOOTER, S.IMAGE, S.TABLE):
            emitted.append(r)
            members[r["node_id"]] = [r | {"text": r["text"] if r["type"] == S.IMAGE else newline}]
            continue
        candidate = r["type"] == S.TITLE or r["parent_id"] is None
        if candidate and (r["type"] == S.TITLE or len(r["text"]) > 1024 or first):
            title = r["type"] == S.TITLE
            new = r | {"type": S.COMPOSITE if title else S.TEXT_COMPOSITE, "text": newline if title else r["text"]}
            emitted.append(new)
            members[r["node_id"]] = [new]
            anchors[r["node_id"]] = r
        else:
            open_ones = [e["node_id"] for e in emitted if e["type"] not in (S.TABLE, S.IMAGE)]
            target = r["parent_id"] if r["parent_id"] in anchors else open_ones[-1] if open_ones else None
            if target is not None:
                members[target].append(r)
        first = first and not candidate
    out = []
    for e in emitted:
        kind, text = fold(members[e["node_id"]])
        out.append(e | {"type": kind, "text": text})
    return out


def test_section_text(got, nodes):
    truth = [r for rows in nodes.values() for r in sections(rows)]
    columns = ("doc_id", "seq", "node_id", "type", "text")
    assert key(got("section_text"), *columns) == key(truth, *columns)


def repeated(rows):
    """Ids of nodes of which the first or last three of some page hold one that is as good as the same."""
    gone = set()
    pages = defaultdict(list)
    for r in rows:
        pages[r["page"]].append(r)
    for end in (slice(0, 3), slice(-3, None)):
        zone = [r for page in pages.values() for r in page[end] if r["type"] not in (S.IMAGE, S.TABLE)]
        texts = defaultdict(list)
        for r in zone:
            texts[r["text"]].append(r["node_id"])
        distinct = sorted(texts)
        for i, a in enumerate(distinct):
            if len(texts[a]) > 1:
                gone |= set(texts[a])
            for b in distinct[:i]:
                if 2 * min(len(a), len(b)) >= 0.8 * (len(a) + len(b)) and indel_ratio(a, b) >= 80:
                    gone |= {*texts[a], *texts[b]}
    return gone


def test_repeated_boilerplate_fuzzy(got, nodes):
    truth = {(d, i) for d, rows in nodes.items() for i in repeated(rows)}
    assert {(r["doc_id"], r["node_id"]) for r in got("repeated_boilerplate_fuzzy")} == truth and truth


def test_ingested_sections(got, docs):
    truth = []
    for d, text in docs.items():
        rows = nodes_of(d, text) if text is not None else []
        for r in rows:
            plain = re.sub(r"\(cid:[0-9]+\)", "", re.sub(r"[\x00-\x1f\x7f-\x9f]", "", r["text"]))
            for found, word in tx.ABBREVIATIONS:
                plain = re.sub(r"(?i)\b" + found.replace(r"[\s\p{Z}]", r"\s"), word, plain)
            r["text"] = plain
        rows = merge_runs(merge_runs(rows, S.TITLE, True), S.LIST_ITEM, False)
        gone = repeated(rows)
        rows = [r | {"parent_id": None if r["parent_id"] in gone else r["parent_id"]} for r in rows if r["node_id"] not in gone]
        rows = sorted(sections(rows), key=lambda r: r["seq"])
        ids = [None, *(r["node_id"] for r in rows), None]
        truth += [r | {"prev_id": a, "next_id": z} for r, a, z in zip(rows, ids, ids[2:])]
    columns = ("doc_id", "seq", "node_id", "prev_id", "next_id", "type", "text")
    assert key(got("ingested_sections"), *columns) == key(truth, *columns)


@pytest.mark.parametrize(("name", "pattern"), [("regex_phone", tx.PHONE), ("regex_date", tx.DATE), ("regex_time", tx.TIME), ("regex_address", tx.ADDRESS), ("regex_email", tx.EMAIL)])
def test_patterns(got, docs, name, pattern):
    flags = re.match(r"\(\?(\w+)\)", pattern)
    plain = re.compile(pattern[flags.end() if flags else 0 :], re.I if flags and "i" in flags[1] else 0)
    truth = {d: None if t is None else [m[0] for m in plain.finditer(t)] for d, t in docs.items()}
    for r in got(name):
        assert r["found"] == (None if truth[r["doc_id"]] is None else "|".join(truth[r["doc_id"]]))


def test_document_keywords(got, docs):
    truth = {d: ", ".join(sorted({k for k, _ in keywords(t, 5)})) for d, t in docs.items() if t}
    assert {r["doc_id"]: r["keywords"] for r in got("document_keywords")} == {d: k for d, k in truth.items() if k}


def tree_summary(rows, width=10):
    """Groups of groups, until there is one."""
    level = [(r["seq"], r["text"]) for r in rows]
    while True:
        level = [(at, key_sentences([t for _, t in run if t], 3)) for at, run in groupby(level, lambda x: x[0] // width)]
        if len(level) == 1:
            return level[0][1], key_sentences([level[0][1]] if level[0][1] else [], 1)


def test_document_summaries(got, nodes):
    truth = {}
    for d, rows in nodes.items():
        if rows:
            truth[d] = tree_summary(rows)
    assert {r["doc_id"]: (r["summary"], r["summary_oneline"]) for r in got("document_summaries")} == truth


def words(text):
    return {w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w}


def likeness(a, b):
    a, b = words(a), words(b)
    return round(len(a & b) / (len(a) * len(b)) ** 0.5, 6) if a and b else 0.0


def test_routed_questions(got, passages, nodes):
    lines = {}
    for d, rows in nodes.items():
        if rows:
            lines[d] = tree_summary(rows)[1]
    found = defaultdict(dict)
    for r in got("routed_questions"):
        found[r["query_id"]][r["rank"]] = (r["doc_id"], r["score"])
    for q, text in passages.items():
        best = sorted(((-likeness(text, s), d) for d, s in lines.items() if words(text) & words(s)))[:3]
        assert found.get(q, {}) == {n: (d, pytest.approx(-s)) for n, (s, d) in enumerate(best, 1)}


def test_sentence_spans_and_windows(got, docs):
    each = {d: split_sentences(t) for d, t in docs.items() if t is not None}
    assert {(r["doc_id"], r["n"]): (r["start"], r["end"], r["text"]) for r in got("sentence_spans")} == {(d, n): s for d, ss in each.items() for n, s in enumerate(ss)}
    assert all(docs[d][a:z] == t for d, ss in each.items() for a, z, t in ss)
    truth = {(d, n): (ss[n][2], " ".join(t for _, _, t in ss[max(0, n - 1) : n + 2])) for d, ss in each.items() for n in range(len(ss))}
    assert {(r["doc_id"], r["n"]): (r["original_text"], r["window"]) for r in got("sentence_windows")} == truth


def test_semantic_split(got, docs):
    """By the vectors of the neighbourhoods' texts, where the query sums those of sentences."""

    def vector(text):
        v = np.zeros(64)
        for token in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(token.encode())
            v[h % 64] += 1 if h >> 16 & 1 else -1
        return v

    truth = {}
    for d, text in docs.items():
        told = [t for _, _, t in split_sentences(text or "")]
        near = [vector(" ".join(told[max(0, i - 3) : i + 4])) for i in range(len(told))]
        sizes = [float(v @ v) ** 0.5 for v in near]
        apart = [None] + [round(1 - float(near[i - 1] @ near[i]) / (sizes[i - 1] * sizes[i]), 6) if sizes[i - 1] * sizes[i] else None for i in range(1, len(told))]
        known = [x for x in apart if x is not None]
        limit = np.percentile(known, 95) if known else np.inf
        group, groups = 0, []
        for t, x in zip(told, apart):
            group += x is not None and x > limit + 1e-12
            groups.append((group, t))
        for g, run in groupby(groups, lambda x: x[0]):
            run = [t for _, t in run]
            truth[d, g] = (len(run), " ".join(run))
    assert {(r["doc_id"], r["group"]): (r["n_sentences"], r["text"]) for r in got("semantic_split")} == truth


@pytest.fixture(scope="module")
def retrieved(spark, small_tables):
    """query -> (rank, node, score), as the query that SQL checks gives them."""
    out = defaultdict(list)
    for r in QUERIES["bm25_topk"](spark, small_tables).collect():
        out[r["query_id"]].append((r["rank"], r["node_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_sentence_prune(got, docs, passages, retrieved):
    truth = {}
    for q, found in retrieved.items():
        for _, d, _ in found:
            told = [t for _, _, t in split_sentences(docs[d])]
            order = sorted(range(len(told)), key=lambda i: (-likeness(passages[q], told[i]), i))
            truth[q, d] = " ".join(told[i] for i in sorted(order[: max(1, int(len(told) * 0.2))])) if told else docs[d]
    assert {(r["query_id"], r["node_id"]): r["text"] for r in got("sentence_prune")} == truth


def test_compact_pack(got, docs, retrieved):
    truth = {}
    for q, found in retrieved.items():
        packs = []
        for _, d, _ in found:
            if packs and sum(map(len, packs[-1])) + len(docs[d]) <= 4096:
                packs[-1].append(docs[d])
            else:
                packs.append([docs[d]])
        truth |= {(q, n): (len(p), "\n\n".join(p)) for n, p in enumerate(packs)}
    assert {(r["query_id"], r["pack"]): (r["n_contexts"], r["context"]) for r in got("compact_pack")} == truth


def test_settled_results(got, nodes):
    truth = {}
    for d, rows in nodes.items():
        at = {r["node_id"]: i for i, r in enumerate(rows)}
        parent = {r["node_id"]: r["parent_id"] for r in rows}
        children = Counter(p for p in parent.values() if p is not None)
        now = [(r["node_id"], float(len(r["text"]))) for r in sorted(rows, key=lambda r: (-len(r["text"]), r["seq"]))[:5]]
        while True:
            before = {n for n, _ in now}
            filled, there = [], {n for n, _ in now}
            for (a, x), (b, y) in zip(now, [*now[1:], (None, 0.0)]):
                filled.append((a, x))
                if b is not None and at[b] - at[a] == 2 and (middle := rows[at[a] + 1]["node_id"]) not in there:
                    filled.append((middle, (x + y) / 2))
                    there.add(middle)
            scores = defaultdict(list)
            for n, x in filled:
                if parent[n] is not None:
                    scores[parent[n]].append(x)
            up = {p: sum(v) / len(v) for p, v in scores.items() if len(v) / children[p] > 0.5}
            now = [(n, x) for n, x in filled if parent[n] not in up]
            now += sorted(((p, x) for p, x in up.items() if p not in {n for n, _ in now}), key=lambda r: (-r[1], r[0]))
            if {n for n, _ in now} == before:
                break
        for rank, (n, x) in enumerate(sorted(now, key=lambda r: (-r[1], r[0])), 1):
            truth[d, n] = rank, round(x, 6)
    assert {(r["query_id"], r["node_id"]): (r["rank"], r["score"]) for r in got("settled_results")} == truth


def test_cited_nodes_and_citations(got, docs, passages, retrieved):
    answers = {r["query_id"]: r for r in got("citation_fuzzy")}
    named = defaultdict(set)
    for r in got("cited_nodes"):
        named[r["query_id"]].add(r["node_id"])
    for q, response in passages.items():
        sources = [(d, docs[d]) for _, d, _ in retrieved.get(q, []) if docs[d]]
        sources = [s for i, s in enumerate(sources) if s[1] not in [t for _, t in sources[:i]]]
        assert named.get(q, set()) == {d for d, t in sources if align(response, t)[0] >= 60}
        tagged, n, quotes, end = "", 0, [], 0
        for a, z, told in split_sentences(response):
            best = (0.0, None)
            for d, text in sources:
                score, s1, e1, s2, e2 = align(told, text)
                if score >= 60 and e1 > s1 and e2 > s2:
                    score = round(indel_ratio(text[s2:e2], told[s1:e1]) * (e1 - s1) / len(told), 6)
                    if score > best[0]:
                        best = (score, (d, s1, s2, e2))
            tagged += response[end:a]
            place = 0
            if best[1]:
                d, s1, s2, e2 = best[1]
                place = nearest_whitespace(told, s1, True) if s1 else 0
                tagged += told[:place] + f" [{n}] "
                quotes.append(snippet(docs[d], s2, e2))
                n += 1
            tagged += told[place:]
            end = z
        tagged += response[end:]
        assert answers[q]["n_citations"] in ((n,) if n else (0, None, -1))
        assert answers[q]["response"].split("\n\n----- Citations")[0] == tagged
        for quote in quotes:
            assert quote in answers[q]["response"]


def test_cited_answers(got, passages):
    """Every question is answered, and every tag in a response has its citation."""
    rows = got("cited_answers")
    assert sorted(r["query_id"] for r in rows) == sorted(passages)
    for r in rows:
        assert re.findall(r" \[(\d+)\] ", r["response"] or "") == [str(i) for i in range(r["n_citations"])]
    assert sum(r["n_citations"] for r in rows) > 0


BLOCK_TAGS = {"h1": S.TITLE, "h2": S.TITLE, "h3": S.TITLE, "p": S.NARRATIVE, "li": S.LIST_ITEM, "div": S.PLAIN}


def test_elements_from_html(got, rows_of):
    """The text of pages by a reader of tags of its own, for the tags that these pages have."""
    import html as h

    found = defaultdict(list)
    for r in sorted(got("elements_from_html"), key=lambda r: (r["doc_id"], r["seq"])):
        found[r["doc_id"]].append((r["category"], r["text"]))
    for page, source in rows_of("SELECT page_id, html FROM pages"):
        source = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<(script|style)\b.*?</\1>|<!DOCTYPE[^>]*>", "", source or "")
        kind, region, text, out = S.PLAIN, [], "", []

        def end(kind, region, text):
            plain = " ".join(text.split())
            return [(region[-1] if region else kind, plain)] if plain else []

        for tag, data in re.findall(r"<([^>]*)>|([^<]+)", source):
            name = tag.split()[0].lower() if tag.strip() else ""
            if data:
                text += h.unescape(data)
            elif name == "br":
                text += " "
            elif name.strip("/") in {*BLOCK_TAGS, "ul", "ol", "article", "nav", "footer", "body", "html", "main", "section", "table", "tr", "td", "header"}:
                out += end(kind, region, text)
                text = ""
                if name in ("nav", "header") or tag.startswith('div class="ad"'):
                    region.append(S.HEADER)
                elif name == "footer":
                    region.append(S.FOOTER)
                elif name in ("/nav", "/footer", "/header") or name == "/div" and region:
                    region.pop()
                kind = BLOCK_TAGS.get(name, S.PLAIN) if not name.startswith("/") else S.PLAIN
                if name in ("ul", "ol"):
                    kind = S.PLAIN
        out += end(kind, region, text)
        assert found.get(page, []) == out, page
