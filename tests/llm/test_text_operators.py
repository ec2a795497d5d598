"""Quality, lines, chat, mixing: against plain Python and the stated results for odd rows."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewell.llm import chat, lines, mixing, quality



def table(spark, *rows):
    """Documents (doc_id, text, source) with other columns whose names the operators use themselves."""
    schema = "doc_id long, text string, source string, lang string, n_chars long, _t string, key string"
    return spark.createDataFrame([(*r, None, None, "x", "y") for r in rows], schema)


def brute_quality(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    ls = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(covered)


def test_quality_ledger(spark):
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x y z x y z x y z\nx y\nx y", "é # $ b\x0bc " * 30, "one two " * 2000, "A!! B!! " * 40]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1, "", "s"), (None, "a a a a", None)]
    got = quality.ledger(table(spark, *rows)).collect()
    for r, (_, t, _) in zip(got, rows, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), t
    assert all(r.failed_bits & 1 for r in got if r.n_words < 50)
    assert quality.ledger(table(spark, *rows).limit(0)).count() == 0


def test_ablation_agrees_with_policies(spark):
    rows = [(i, "word " * (i * 7), "s") for i in range(20)] + [(99, " ".join(f"w{k}" for k in range(90)), "s")]
    entries = quality.ledger(table(spark, *rows)).cache()
    kept = quality.apply_policy(entries, "v1").filter("kept").count()
    found = quality.ablation(entries).collect()
    assert {r.rule for r in found} == set(quality.POLICIES["v1"]) and all(r.kept == kept for r in found)
    assert all(r.n_kept_without == r.kept + r.n_failed_alone for r in found)
    assert quality.apply_policy(entries, "base").filter("kept").count() >= kept


def test_line_spread(spark):
    mark = "All rights reserved here."
    rows = [(i, f"own text number {i} of some length to keep\n {mark} \nand more {i}", f"s{i}") for i in range(6)]
    rows += [(50 + i, mark, f"s{i}") for i in range(3)] + [(60, None, "s1"), (61, "", None), (62, f"solo line\n{mark}\nlonger line than the mark itself", None)]
    rows += [(70 + i, "few sites\nbut long enough to stay here", "s1") for i in range(20)]
    got = {r.doc_id: r for r in lines.drop_boilerplate(table(spark, *rows)).collect()}
    assert got[0].text == "own text number 0 of some length to keep\nand more 0" and got[0].n_removed == 1 and got[0].n_lines == 3
    assert got[50].text == mark and got[50].n_removed == 0  # would lose all
    assert got[60].text is None and got[60].n_lines == 0 and got[61].text == ""
    assert got[62].text == "solo line\nlonger line than the mark itself"
    assert got[75].n_removed == 0 and len(got) == len(rows)
    assert set(table(spark, *rows).columns) < set(lines.drop_boilerplate(table(spark, *rows)).columns)
    assert lines.drop_boilerplate(table(spark, *rows).limit(0)).count() == 0


def test_only_copies_keep_their_widespread_lines(spark):
    import corpus_pipeline

    mark = "All rights reserved here. " * 8
    rows = [(i, f"own text number {i} " * 20 + f"\n{mark}", f"s{i}") for i in range(6)]
    rows += [(10, f"short page\n{mark}", "s1"), (11, mark, "s1"), (12, mark, "s2"), (13, f"  {mark}\n\n{mark}", None)]
    rows += [(14, f"one site\n{mark}", "s3"), (15, f"one site\n{mark}", "s3"), (16, f"odd\n{mark}", None), (16, f"odd\n{mark}", "s4")]
    docs = table(spark, *rows)
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs, only_copies=True).collect()}
    assert all(got[i].n_removed == got[i].n_spread == 1 for i in (*range(6), 10, 14, 15, 16)) and got[10].text == "short page"
    assert got[14].text == "one site" and all(got[i].text == mark and got[i].n_removed == 0 for i in (11, 12))
    assert got[11].n_spread == 1 and got[13].n_spread == 2 and got[13].n_removed == 2 and got[13].text == ""
    assert lines.drop_boilerplate(docs.limit(0), only_copies=True).count() == 0
    staged = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, "").collect()}
    assert staged[10].text == "short page" and staged[10].n_chars == 10 and staged[11].text == mark


def test_near_threshold_counts_are_exact(spark):
    rows = [(i * 100 + j, f"line {i}\nfill {i} {j} long enough text", f"s{j}") for i in range(3, 8) for j in range(i)]
    got = lines.drop_boilerplate(table(spark, *rows)).groupBy((F.col("doc_id") / 100).cast("int").alias("i")).agg(F.max("n_removed").alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: int(i >= 5) for i in range(3, 8)}


TURNS = "conv_id long, turn long, role string, text string, _turn string"


def test_chat_round_trip(spark):
    odd = ["\\", "\\\\l", "### user: x</turn>\n", "<+>", "a\n\nb", "", None, "\\h\\c#<", "é😀 # tail\\"]
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t, "z") for i, t in enumerate(odd)]
    rows += [(2, 0, None, "no role", "z"), (2, None, "a: b#<", "null turn", "z"), (2, 0, None, "no role", "z"), (None, 1, "assistant", "null id", "z")]
    laid = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = laid.select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {r.conv_id: r for r in got}
    assert [(x.role, x.text) for x in by[1].t] == [(r, t or "") for _, _, r, t, _ in rows[: len(odd)]]
    assert by[1].loss == "".join(t or "" for _, _, r, t, _ in rows[: len(odd)] if r == "assistant")
    assert [(x.role, x.text) for x in by[2].t] == [("a: b#<", "null turn"), ("", "no role"), ("", "no role")]
    assert by[None].loss == "null id" and by[2].loss == "" and by[1].formatted.count("### ") == 6
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_mix_targets(spark):
    words = lambda n: " ".join("w" * 1 for _ in range(n))
    rows = [(s * 1000 + i, words(n) + f" {i}", f"s{s}") for s, n in ((0, 9), (1, 40), (2, 30)) for i in range(30)]
    rows += [(9005, None, "s0"), (9006, "", None), (9007, "null source", None), (9007, "null source", None), (9008, "a b c", "s1")]
    units = mixing.mix(table(spark, *rows)).cache()
    per_row = mixing.taken_per_row(units).toPandas()
    assert len(per_row) == len(rows) and (per_row.taken <= 3 * per_row["size"]).all()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    source = {i: s for i, _, s in rows}
    per_row["source"] = per_row.doc_id.map(source).fillna("-")
    each = per_row.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    weights, caps, left = {"s0": 5, "s1": 2, "s2": 1, "-": 5}, {}, float(total)
    want, open_ = {}, dict(weights)
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * each["size"][s] + 1e-9]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = caps[s] = 3.0 * each["size"][s]
            left -= want[s]
            del open_[s]
    for s, t in want.items():
        assert abs(each.target[s] - t) < 1e-6 and abs(each.taken[s] - t) <= 2, s
    order = mixing.training_order(units).orderBy("position").collect()
    assert [r.time for r in order] == sorted(r.time for r in order)
    ends = [r.position + r.words for r in order]
    assert [0, *ends[:-1]] == [r.position for r in order]
    again = mixing.taken_per_row(mixing.mix(table(spark, *rows[::-1]))).toPandas()
    assert sorted(zip(per_row.key, per_row.taken)) == sorted(zip(again.key, again.taken))
    assert mixing.mix(table(spark, *rows).limit(0)).count() == 0


def test_digest_columns_match_plain_python(spark):
    rows = [(1, 0, "user", "q", "z"), (1, 1, "assistant", "answer é", "z")]
    laid = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    text = laid.select(F.sha2(chat.masked_text(F.col("formatted"), F.col("loss_spans")), 256)).collect()[0][0]
    assert text == hashlib.sha256("answer é".encode()).hexdigest()


def test_ledger_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c a b c", "s"), (2, None, "s")]
    docs = table(spark, *rows).withColumns({"n_words": F.lit(-5), "_kept": F.lit("k"), "_w": F.lit("w")})
    got = quality.ledger(docs, keep=("doc_id", "_t", "n_words", "_kept", "_w", "key"))
    assert got.columns[:5] == ["doc_id", "_t", "_kept", "_w", "key"] and got.columns.count("n_words") == 1
    assert [(r.doc_id, r._t, r._kept, r._w, r.n_words, r.n_repeat_words) for r in got.collect()] == [(1, "x", "k", "w", 6, 6), (2, "x", "k", "w", 0, 0)]
    assert [r.r for r in got.select(quality.sole_rule("base").alias("r")).collect()] == [None, "few_words"]


def test_a_long_conversation_and_a_long_text(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} #", "z") for i in range(3000)]
    laid = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = laid.select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert got.n == 3000 and got.loss == "".join(f"turn {i} #" for i in range(1, 3000, 2))
    units = mixing.mix(table(spark, (1, "w " * 300_000, "s"), (2, "w w", "s")))
    assert {r.doc_id: r["size"] for r in units.collect()} == {1: 300_000, 2: 2}
