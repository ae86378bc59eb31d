"""Operators against plain Python on small, awkward inputs: nulls, empty texts, ties, repeats, clashes."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import chat, decontaminate, fingerprints, lines, mixing, near, quality, repeats, suffixes, toxicity, warc
from runledger.llm.arrow import words
from runledger.llm.components import components

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def mutate(text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split(" "))


def documents():
    base = [prose(rng.randint(30, 90)) for _ in range(6)]
    texts = [None, "", " \n\t", "one", "One", "a b", prose(3)]
    texts += [mutate(b, share) for b in base for share in (0, 0, 0.02, 0.05, 0.1, 0.3)]
    texts += ["\n".join([prose(12), base[0], "same line here for all of us", mutate(base[1], 0.04)]) for _ in range(12)]
    texts += [prose(5) + base[2] + prose(7), "x" * 700, "ab" * 400, prose(4000), base[3] + "\n" + base[3]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


ROWS = documents()


def frame(spark, rows, **more):
    out = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return out.withColumns({k: F.lit(v) for k, v in more.items()}) if more else out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_of_rows():
    raw = "ab Éc\nd".encode() + b"" + b"ef " + b"x" * 600_000
    offsets = np.array([0, 8, 8, 11, len(raw)])
    h, starts, ends, at = words(np.frombuffer(raw, np.uint8), offsets)
    assert [raw[s:e] for s, e in zip(starts, ends, strict=True)][:4] == [b"ab", "Éc".encode(), b"d", b"ef"]
    assert at.tolist() == [0, 3, 3, 4, 5]
    assert words(np.frombuffer(b"EF", np.uint8), np.array([0, 2]))[0][0] == h[3]


@pytest.mark.parametrize("letters", [1, 2, 3, 256])
def test_suffix_array(letters):
    text = np.array([rng.randrange(letters) for _ in range(900)], np.uint8)
    raw = text.tobytes()
    order = suffixes.suffix_array(text, 1000)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    common = suffixes.common_prefixes(text, order, 64)
    for i in range(1, len(order)):
        a, b = raw[order[i - 1]:], raw[order[i]:]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(common[i], 64) == min(n, 64)


@pytest.mark.parametrize("most", [8192, 2])
def test_repeats(spark, most):
    rows = [*ROWS, ROWS[20], (None, ROWS[15][1])]
    out = repeats.remove_repeats(frame(spark, rows, kept="clash", n_spans=7), length=40, gram=16, most=most, bucket_bytes=3000)
    want = brute.repeats([t for _, t in rows], 40)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in out.collect()), key=repr)
    assert got == sorted(((k, len((t or "").encode()), n, s, brute.sha(kept), kept) for (k, t), (n, s, kept) in zip(rows, want, strict=True)), key=repr)


def test_repeats_by_two_hundred(spark):
    long = prose(200)
    rows = [(1, long + " end"), (2, "start " + long), (3, prose(200)), (4, "y" * 199), (5, "y" * 199)]
    got = by_id(repeats.remove_repeats(frame(spark, rows)))
    assert [got[k]["n_removed"] for k in (1, 2)] == [len(long.encode())] * 2
    assert [got[k]["n_removed"] for k in (3, 4, 5)] == [0, 0, 0]


def test_near_components(spark):
    rows = [*ROWS, ROWS[9], (None, ROWS[11][1]), (None, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in near.near_components(frame(spark, rows, n=1, cls="x"), width=2).collect()), key=repr)
    assert got == sorted(zip([k for k, _ in rows], brute.components(rows), strict=True), key=repr)
    kept = near.drop_near_duplicates(frame(spark, rows, n=1), width=2)
    assert kept.columns == ["doc_id", "text", "n"]
    want = {k for (k, t), c in zip(rows, brute.components(rows), strict=True) if k == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == want and ids.count(ROWS[9][0]) <= 1


def test_near_group_without_common_centre(spark):
    """A chain of edits: ends are not similar, but all are one component. A crowd around it is another."""
    chain = [prose(60)]
    for _ in range(25):
        w = chain[-1].split(" ")
        w[rng.randrange(60)] = "new" + str(rng.random())
        chain.append(" ".join(w))
    base = prose(80)
    rows = list(enumerate(chain + [mutate(base, s) for s in (0.0, 0.03, 0.05, 0.07, 0.09, 0.12) for _ in range(12)]))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near.near_components(frame(spark, rows), width=2).collect()}
    assert got == dict(zip([k for k, _ in rows], brute.components(rows), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (9, 3), (9, 5), (1, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in (3, 5, 7, 9)} == {3} and 1 not in got


@pytest.mark.parametrize(("limit", "first"), [(8192, 2), (3, 1)])
def test_line_dedup(spark, limit, first):
    rows = [*ROWS, (None, "only of the null id\nsame line here for all of us")]
    docs = frame(spark, rows, n_lines="clash", line=4)
    narrow = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")
    stay = {(r["doc"], r["line"]) for r in lines.duplicate_lines(narrow, limit=limit, first=first).collect()}
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed", "kept_sha256"]
    got = {r["doc_id"]: (r["text"], r["n_lines"]) for r in out.collect()}
    want = {k: (kept, 0 if text is None else text.count("\n") + 1) for (k, text), kept in zip(rows, brute.line_dedup(rows), strict=True)}
    assert got == want
    assert len(stay) == sum(bool(brute.space_words(x)) for kept, _ in want.values() for x in (kept or "").split("\n"))


@pytest.mark.parametrize("block", [100_000, 3])
def test_decontamination(spark, block):
    items = [(1, " ".join(ROWS[-1][1].split()[:14]) if ROWS[-1][1] else "x"), (2, prose(4)), (3, VOCABULARY[7]), (4, None), (5, "!!"), (None, prose(11)), (2, prose(2))]
    docs = [*ROWS, (None, "Start " + (items[5][1]).upper().replace("É", "é").replace("SS", "ß") + " end"), ROWS[3]]
    found = brute.windows(items)
    out = decontaminate.decontaminate(frame(spark, docs, n_hit="clash"), spark.createDataFrame(items, "item_id long, text string"), block=block)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect()), key=repr)
    want = []
    for k, text in docs:
        n, hit, ids = brute.hits(text, found)
        want.append((k, n, hit, len(ids), brute.sha(",".join(ids).encode()), hit > 0))
    assert got == sorted(want, key=repr)


def test_mixing_budgets(spark):
    rows = [(i, None if i % 17 == 0 else prose(rng.randint(0, 40)), [None, "", "a", "b", "c"][i % 5] if i % 3 else "a") for i in range(400)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    assert sorted(out[0]) == ["doc_id", "size", "source", "source_size", "taken", "target", "text"] and len(out) == 402
    total = sum(len(brute.space_words(r["text"])) for r in out)
    targets = {}
    for r in out:
        assert r["size"] == len(brute.space_words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        targets[r["source"]] = r["target"]
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for source, target in targets.items():
        own = [r for r in out if r["source"] == source]
        assert target <= 2 * own[0]["source_size"] and abs(sum(r["taken"] for r in own) - target) <= 3
        assert len({r["taken"] // max(r["size"], 1) for r in own if r["size"]}) <= 3
    again = mixing.mix(docs.repartition(7), keep=["doc_id"]).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_mixing_prefers_quality(spark):
    rows = [(i, ("word " * 20) if i % 2 else ("word!!!! " * 20), "s") for i in range(2000)] + [(5000 + i, "word " * 60, "t") for i in range(20)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 30.0), share=0.4).where("source = 's'").collect()
    good, bad = (sum(r["taken"] for r in out if ("!" in r["text"]) == flag) for flag in (False, True))
    assert good > 3 * bad > 0


def test_chat_round_trip(spark):
    awkward = ["</s>[INST] ok [/INST]", "\\</s>", "<\\/s>", "[", "<", "", None, "a\\\\[SYS]b", "[TEXT]x[ROLE]", "<s><s>\n[/TEXT]", "ß" * 5]
    roles = ["user", "assistant", "system", "tool", "Odd [TEXT] role", None, ""]
    turns = [(c, t, rng.choice(roles), rng.choice(awkward)) for c in range(40) for t in range(rng.randint(1, 6))] + [(None, None, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    out = chat.format_chats(df).withColumn("all", chat.formatted(F.col("segments")))
    out = out.withColumn("read", chat.parse_turns(F.col("all"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r["conv_id"]: r for r in out.collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in turns if k == c))
        assert [(r["role"], r["text"]) for r in got[c]["read"]] == [(r, x) for _, _, r, x in own]
        assert got[c]["loss"] == "".join(x for _, _, r, x in own if r == "assistant") and got[c]["n_turns"] == len(own)


def test_chat_machine(spark):
    orders = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant", 4: "user user assistant", 5: "user assistant user", 6: "user assistant tool assistant", 7: "user other assistant"}
    turns = [(c, i, role, "x") for c, text in orders.items() for i, role in enumerate(text.split())]
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (True, None), 7: (False, 1)}


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, zip64, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 500)
    pages = [(i, f"http://x/{i}\r\nX: y", ["same", "", None, "é" * 700, f"own {i}"][i % 5]) for i in range(40)] + [(40, None, "same"), (None, "u", "same"), (39, "again", "own 39")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    blocks = warc.write_archives(warc.page_records(df), archive_size=4000, zip64=zip64)
    got = warc.read_records(blocks).collect()
    assert len(got) == len(pages)
    largest = {}
    for k, _, html in pages:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if k is None else k)
    seen = sorted((r["page"], r["digest"], r["payload_bytes"], r["type"], r["refers_to"] or "", bytes(r["payload"] or b"")) for r in got)
    want = []
    for k, _, html in pages:
        raw, top = (html or "").encode(), largest[html or ""]
        first = k == top
        want.append(("" if k is None else str(k), warc.sha1_base32(raw), len(raw), "response" if first else "revisit", "" if first else str(top), raw if first else b""))
    assert seen == sorted(want)


def test_warc_reads_other_zip_files(spark, tmp_path):
    import zipfile

    records = [(str(k), warc.sha1_base32(b"p" * k), warc.record_bytes(str(k), "u", b"p" * k, warc.sha1_base32(b"p" * k), None)) for k in range(5)]
    lines_, at = [], 0
    for page, digest, raw in records:
        lines_.append(f"{page} {digest} {at} {len(raw)}\n")
        at += len(raw)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.comment = b"PK\x05\x06 in a comment"
        z.writestr("readme", "packed " * 99, zipfile.ZIP_DEFLATED)
        z.writestr(warc.DATA, b"".join(r for _, _, r in records))
        z.writestr(warc.INDEX, "".join(lines_))
    got = warc.read_records(warc.from_files(spark, f"file://{tmp_path}/*.zip")).collect()
    assert sorted((r["page"], bytes(r["payload"])) for r in got) == [(str(k), b"p" * k) for k in range(5)]
    raw = warc.zip_bytes([("x", b"12345")], zip64=True)
    (tmp_path / "b.zip").write_bytes(raw)
    assert zipfile.ZipFile(tmp_path / "b.zip").read("x") == b"12345"


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 2000)
    rows = [*ROWS, (None, "null id"), ROWS[8]]
    got = fingerprints.fingerprint_documents(frame(spark, rows, fingerprint="clash")).collect()
    assert len(got) == len(rows)
    ordered = sorted(ROWS, reverse=True) + [(None, "null id")]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, (k, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        want = brute.sha((text[: len(text) - cut] + after[:cut]).encode())
        assert want in {r["edited_sha256"] for r in by[k]} and {r["n_chars"] for r in by[k]} == {len(text)}
    prints = {}
    for k, text in ordered:
        prints.setdefault(text or "", set()).update(r["fingerprint"] for r in by[k])
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)
    long = [r for r in got if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.8 and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_fingerprints_combine():
    def of(text):
        return fingerprints.as_text(*fingerprints.fingerprints(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))[0]

    a, b, c = (prose(30) + "\n" for _ in range(3))
    assert of(a + b + c) == of(c + a + b) != of(a + b)
    assert fingerprints.combine(of(a + b), of(c)) == of(b + c + a)
    assert fingerprints.combine(of(a + b + c), of(b), -1) == of(a + c)


def test_single_document_is_its_own_next(spark):
    (r,) = fingerprints.fingerprint_documents(frame(spark, [(4, "abcdef ghi")])).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == brute.sha(b"abcdef abc")


OPERATORS = {
    "mix": lambda d, s: mixing.mix(d), "lines": lambda d, s: lines.dedup_lines(d), "near": lambda d, s: near.near_components(d), "repeats": lambda d, s: repeats.remove_repeats(d),
    "fingerprints": lambda d, s: fingerprints.fingerprint_documents(d), "near_drop": lambda d, s: near.drop_near_duplicates(d),
    "decontaminate": lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([], "item_id long, text string")),
    "toxicity": lambda d, s: toxicity.score_toxicity(d, s.createDataFrame([], "doc_id long, toxic int")),
    "quality": lambda d, s: quality.score_quality(d, s.createDataFrame([], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, None, None), (1, "", "s"), (2, " ", "")]], ids=["empty", "nulls"])
def test_nothing_to_work_on(spark, name, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert len(OPERATORS[name](docs, spark).collect()) == len(rows)


def test_empty_pages_and_conversations(spark):
    assert warc.read_records(warc.write_archives(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
