"""The registered opN queries against their SQL, and the pipeline stage by stage."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import langid, lines, mixing, pieces, queries, simhash
from tidewell.llm.common import held_out

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, _key string"


def as_rows(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert as_rows(got.columns, [tuple(r) for r in got.collect()]) == as_rows(names, want.fetchall())


WORDS = {"en": "the thing with that other brother and this way of writing", "fr": "oui nous vous avons toujours mieux pour ceux qui sont"}


def documents(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in rows], DOCS)


def corpus(spark):
    """Odd rows among plain ones: nulls in every column, blank and letterless texts, copies, repeated ids, a shared line, a very long text."""
    rng = random.Random(11)

    def prose(lang, n):
        return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "a", "ing", "er", "e"]) for _ in range(n))

    rows = [(i, prose("en" if i % 2 else "fr", 40 + i), "en" if i % 2 else "fr", f"s{i % 6}") for i in range(60)]
    mark = "this line is the same on every one of the sites"
    rows = [(i, f"{t}\n{mark}" if i % 3 == 0 else t, lang, s) for i, t, lang, s in rows]
    rows += [(100 + k, rows[4][1], "fr", f"s{k % 6}") for k in range(9)]  # copies
    rows += [(4, "another text that has the id of a copied one " + prose("en", 30), "en", "s1"), (4, rows[4][1], "fr", "s4")]
    rows += [(200, None, "en", "s1"), (201, "", None, "s1"), (202, "12 34 !!", "en", None), (203, prose("fr", 50), None, None), (None, prose("en", 60), "en", "s2")]
    rows += [(204, prose("en", 60_000), "en", "s3"), (205, mark, "en", "s3"), (206, mark, "en", "s4")]
    return documents(spark, rows), rows


def brute_mix(rows):
    """How often each row comes, in plain Python."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = {}
    for r in rows:
        key = md5("|".join([str(r[0]) if r[0] is not None else "-", md5(r[3]) if r[3] is not None else "-", md5(r[1] or "")]))
        by.setdefault(r[3], []).append((key, len((r[1] or "").split()), r))
    names = sorted(by, key=lambda x: (x is None, x or ""))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    size = {n: sum(x[1] for x in by[n]) for n in names}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = {n for n in open_ if share[n] > 3 * size[n]}
        target |= {n: 3.0 * size[n] for n in full} or share
        left -= sum(3 * size[n] for n in full)
        open_ = open_ - full if full else set()
    times = {}
    for n in names:
        passes = int(target[n] // size[n]) if size[n] else 0
        rest = round(target[n]) - passes * size[n]
        for _, words, r in sorted(by[n]):
            part = max(0, min(rest, words))
            rest -= words
            if count := passes + (part > 0 and 2 * part >= words):
                times[r] = count
    return times


def test_every_stage_against_brute_force(spark, tmp_path):
    docs, rows = corpus(spark)
    parts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = parts[name] = spark.read.parquet(f"{tmp_path}/{name}")
    said = {k: [tuple(r) for r in v.collect()] for k, v in parts.items()}
    plain = lambda found: sorted(found, key=str)

    # Language ID: the rows that have letters and resemble a language; a missing lang is filled in.
    source, _ = corpus(spark)
    prototypes = langid.fit(source.filter(~held_out(F.col("doc_id"), 4)))
    judged = {(r.doc_id, r.text): r for r in langid.predict(source, prototypes, keep=("doc_id", "text")).collect()}
    want = []
    for i, t, lang, s in rows:
        r, n = judged[(i, t)], len(t or "")
        if r.lang_pred != "und" and r.score >= 0.15 * (n / (n + 200)) ** 0.5:
            want.append((i, t, lang or r.lang_pred, s, n))
    assert plain(said["language_id"]) == plain(want)
    assert {r[0] for r in want} >= {i for i in range(60)} | {203, 204, None} and not {200, 201, 202} & {r[0] for r in want}

    # Line dedup: lines on five sites or more go; pages of such lines alone stay if two sites show them.
    sites = {}
    for _, t, _, s, _ in want:
        for x in {x.strip() for x in t.split("\n")} - {""}:
            sites.setdefault(x, set()).update({s} - {None})
    wide = {x for x, found in sites.items() if len(found) >= 5}
    shown = {}
    for _, t, _, s, _ in want:
        shown.setdefault(frozenset(x.strip() for x in t.split("\n")) - {""}, set()).update({s} - {None})
    clean = []
    for i, t, lang, s, n in want:
        left = "\n".join(x for x in t.split("\n") if x.strip() not in wide)
        copy = len(shown[frozenset(x.strip() for x in t.split("\n")) - {""}]) > 1
        cut = left != t and (len(left) >= 0.5 * len(t) or not copy)
        clean.append((i, left, lang, s, len(left)) if cut else (i, t, lang, s, n))
    assert plain(said["line_dedup"]) == plain(clean)

    # Near dedup: of each component the least (id, fingerprint, digest), once; rows without an id once per text.
    fps = [simhash.fingerprint(r[1]) for r in clean]
    label = list(range(len(clean)))
    for _ in clean:
        for a in range(len(clean)):
            label[a] = min(label[b] for b in range(len(clean)) if bin(fps[a] ^ fps[b]).count("1") <= 3)
    kept = {}
    for r, c in zip(clean, label, strict=True):
        if r[0] is not None and (c not in kept or r[0] < kept[c][0]):
            kept[c] = r
    nulls = {r[1]: r for r in clean if r[0] is None}
    assert plain(said["near_dedup"]) == plain([*kept.values(), *nulls.values()])

    # Mixing: each source's target in whole passes and a part, three times at most; in a part, rows with half their words or more come.
    found = {}
    for r in said["source_mix"]:
        found[r] = found.get(r, 0) + 1
    assert found == brute_mix(said["near_dedup"]) and max(found.values()) <= 3

    # Pieces: the library's ids of every row, and its text back.
    sentencepiece = pytest.importorskip("sentencepiece")
    import hashlib

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    coded = []
    for i, t, lang, s, _ in said["source_mix"]:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        digest = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        coded.append((i, lang, s, len(ids), digest, sp.decode(ids) == t))
    assert plain(said["piece_codes"]) == plain(coded) and all(r[-1] for r in coded)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = documents(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_pipeline_runs_over_a_folder(spark, tmp_path):
    corpus(spark)[0].select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.round_trip for r in got)


def test_line_dedup_of_repeated_and_long_rows(spark):
    mark = "a line that all of the sites have in common"
    long = "\n".join(f"own line {k}" if k % 50 else mark for k in range(1, 30_001))
    rows = [(1, long, "en", f"s{k}") for k in range(6)] * 3 + [(2, f"x {mark}", "en", "s1"), (2, f"x {mark}", "en", "s1"), (3, None, None, None)]
    rows += [(4, f"a fine own line that is long enough\n{mark}", "en", "s2")]
    docs = documents(spark, rows).withColumn("n_lines", F.lit(-1)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = lines.drop_boilerplate(docs, max_share=1.0).collect()
    assert len(got) == len(rows) and all(r.n_removed == 30_000 and r.text == "" and r.n_lines == 30_000 for r in got if r.doc_id == 1)
    assert [r.text for r in got if r.doc_id == 2] == [f"x {mark}"] * 2 and [r.text for r in got if r.doc_id == 4] == ["a fine own line that is long enough"]
