"""The opN queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, credentials, langid, lines, lm, mixing, neighbours, phrases, pieces, prefixes, quality, simhash, toxicity
from .common import held_out


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    """The ledger of ``documents`` under the base policy and the current one, and the rule that alone removes a document."""
    entries = quality.ledger(_table(spark, sf_dir, "documents"))
    entries = quality.apply_policy(quality.apply_policy(entries, "base", "_base_ok"), "v1", "kept")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    entries = entries.withColumn("sole_rule", quality.sole_rule())
    return entries.selectExpr(*columns, "NOT _base_ok AS base_failed", "_base_ok AND kept AS kept", "failed_bits", "sole_rule")


def op1_ablation(spark, sf_dir):
    """Per rule of the current policy: documents that fail it, that fail it alone, and that stay without it."""
    return quality.ablation(quality.ledger(_table(spark, sf_dir, "documents")))


def op2_nearest_vectors(spark, sf_dir):
    """The five nearest found for every fiftieth vector."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_line_dedup(spark, sf_dir):
    """What boilerplate removal does to each document; of those made up of boilerplate, shown copies stay whole."""
    clean = lines.drop_boilerplate(_table(spark, sf_dir, "documents"), only_copies=True)
    return clean.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op7_source_mix(spark, sf_dir):
    """Words that the mix takes from each document, and where its first pass stands in training (-1: nowhere)."""
    units = mixing.mix(_table(spark, sf_dir, "documents"))
    rows = mixing.taken_per_row(units)
    first = mixing.training_order(units).filter("pass = 0").select("key", F.col("position").alias("first_position"))
    return rows.join(first, "key", "left").drop("key").na.fill({"first_position": -1})


def op9_chat_format(spark, sf_dir):
    """Digests of all conversations, and of one that quotes control strings, as read back from the formatted text."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame(
        [(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string"
    )
    laid = chat.format_conversations(table.unionByName(added))
    read = laid.withColumn("_turns", chat.read_turns(F.col("formatted")))
    read = read.withColumn("_loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_simhash_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from labels outside the hold-out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4)
    machine = toxicity.fit(docs, labels.filter(~out), label="toxic")
    found = toxicity.score(docs.select("doc_id", "text"), machine)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return found.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"))


def op8_language_id(spark, sf_dir):
    """Language of every document, learned from documents outside the hold-out."""
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4)
    prototypes = langid.fit(docs.filter(~out))
    found = langid.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_lm_score(spark, sf_dir):
    """Log10 probability of every document, learned from documents outside the hold-out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7)
    found = lm.score(docs, lm.count(docs.filter(~out)))
    return found.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_piece_codes(spark, sf_dir):
    """Digests of every document's piece ids and of the text decoded from them."""
    coded = pieces.encode_documents(_table(spark, sf_dir, "documents"), pieces.model_bytes())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_phrases(spark, sf_dir):
    """The 2,000 most cohesive phrases of two and three words in each language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"), support=10, longest=3, top=2000, inside=50)


def op12_prefix_trie(spark, sf_dir):
    """The trie of all conversations, of which each borrows its first turns from one whose id is divisible by five."""
    rows = prefixes.turns(_table(spark, sf_dir, "conversations"))
    lender = F.col("conv_id") - F.col("conv_id") % 5
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefixes.trie(prefixes.rebuilt(rows, lender, lent, most=8))


def op13_secrets(spark, sf_dir):
    """Secrets of every document: counts and digest of the base spans, and all spans with those of the guess costs."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = credentials.find_secrets(docs, credentials.dictionary(docs))

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "context")
    return found.select("doc_id", *map(number, credentials.KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {
    "op11_phrases": op11_phrases,
    "op13_secrets": op13_secrets,
    "op12_prefix_trie": op12_prefix_trie,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op5_lm_score": op5_lm_score,
    "op6_piece_codes": op6_piece_codes,
    "op4_toxicity": op4_toxicity,
    "op8_language_id": op8_language_id,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op1_quality_rules": op1_quality_rules,
    "op1_ablation": op1_ablation,
    "op3_line_dedup": op3_line_dedup,
    "op7_source_mix": op7_source_mix,
    "op9_chat_format": op9_chat_format,
}

WORDS_SQL = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
TRIM_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LEDGER_SQL = f"""base AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, {WORDS_SQL.replace("coalesce(text, '')", "t")} AS w,
         list_filter(string_split(t, chr(10)), lambda x: trim(x, {TRIM_SQL}) <> '') AS ls FROM base
), win AS (
  SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), twice AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY row
), measured AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(t, '!')) AS n_bangs, regexp_matches(t, '\\p{{L}}') AS has_letter
  FROM split LEFT JOIN covered USING (row)
), ledger AS (
  SELECT *, CAST({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)} AS BIGINT) AS failed_bits FROM measured
)"""
_SOLE = " ".join(f"WHEN {1 << r.bit} THEN '{r.name}'" for r in quality.RULES)
_RULES = ", ".join(f"({1 << r.bit}, '{r.name}')" for r in quality.RULES)

ORACLE_SQL = {
    "op1_quality_rules": f"""WITH {LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept,
       failed_bits, CASE failed_bits {_SOLE} END AS sole_rule FROM ledger""",
    "op1_ablation": f"""WITH {LEDGER_SQL}, rule(bit, rule) AS (VALUES {_RULES})
SELECT count(*) AS rows, count(*) FILTER (WHERE failed_bits = 0) AS kept, rule, count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_failed,
       count(*) FILTER (WHERE failed_bits = bit) AS n_failed_alone, count(*) FILTER (WHERE failed_bits IN (0, bit)) AS n_kept_without
FROM ledger, rule GROUP BY rule, bit""",
    "op7_source_mix": f"""WITH rows AS (
  SELECT doc_id, source, len({WORDS_SQL}) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(md5(source), '-') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents
), each AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM rows GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope
  FROM each
), level AS (
  SELECT max((total - most_before)::DOUBLE / (weights - weight_before)::DOUBLE) AS level FROM (
    SELECT sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
           coalesce(sum(3 * source_size) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before
    FROM weighed
    WINDOW w AS (ORDER BY 3 * source_size / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), target AS (
  SELECT source, source_size, slope, least((3 * source_size)::DOUBLE, level * weight) AS target FROM weighed, level
), unit AS (
  SELECT key, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(size) AS size, count(*) AS copies
  FROM rows GROUP BY key
), placed AS (
  SELECT u.*, source_size, slope, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
         CAST(coalesce(sum(size * copies) OVER (
           PARTITION BY u.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM unit u JOIN target t ON u.source IS NOT DISTINCT FROM t.source
), parted AS (
  SELECT *, greatest(0, least(CAST(round(target) AS BIGINT) - passes * source_size - "offset", size * copies)) AS part
  FROM placed
), pass AS (
  SELECT key, p, CASE WHEN p < passes THEN size * copies ELSE part END AS words,
         least(1.0::DOUBLE, (p * source_size + "offset") / target) AS share, slope
  FROM (SELECT *, unnest(range(0, passes + CASE WHEN part > 0 THEN 1 ELSE 0 END)) AS p FROM parted)
), timed AS (
  SELECT key, p, words, CASE WHEN slope = 0 THEN share
         ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END AS time FROM pass
), ranked AS (
  SELECT key, p, CAST(coalesce(sum(words) OVER (
    ORDER BY time, key, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM timed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(passes * size + floor(part / copies) AS BIGINT) AS taken, coalesce(position, -1) AS first_position
FROM (SELECT *, unnest(range(1, copies + 1)) AS n FROM parted) d LEFT JOIN ranked ON d.key = ranked.key AND ranked.p = 0""",
    "op3_line_dedup": f"""WITH split AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, source, i AS pos, trim(ls[i], {TRIM_SQL}) AS core
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM split WHERE text IS NOT NULL)
), spread AS (
  SELECT core FROM line WHERE core <> '' GROUP BY core HAVING count(DISTINCT source) >= 5
), spots AS (
  SELECT doc_id, list(pos ORDER BY pos) AS gone FROM line SEMI JOIN spread USING (core) GROUP BY doc_id
), cut AS (
  SELECT s.doc_id, text, ls, gone,
         array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10)) AS kept
  FROM split s LEFT JOIN spots g ON s.doc_id = g.doc_id
), line_set AS (
  SELECT text, source, list_sort(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, {TRIM_SQL})), lambda x: x <> ''))) AS lines
  FROM split WHERE text IS NOT NULL AND source IS NOT NULL
), copied AS (
  SELECT DISTINCT text FROM line_set SEMI JOIN (SELECT lines FROM line_set GROUP BY lines HAVING min(source) < max(source)) USING (lines)
), decided AS (
  SELECT *, gone IS NOT NULL AND (length(kept) >= 0.5 * length(text) OR text NOT IN (SELECT text FROM copied)) AS cleaned FROM cut
)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN cleaned THEN len(gone) ELSE 0 END AS BIGINT) AS n_removed,
       CAST(length(CASE WHEN cleaned THEN kept ELSE text END) AS BIGINT) AS kept_chars,
       sha256(CASE WHEN cleaned THEN kept ELSE text END) AS text_sha256
FROM decided""",
    "op11_phrases": r"""WITH piece AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), spot AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM piece
), gram AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT *, unnest([1, 2, 3]) AS k FROM spot) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE k = 1 GROUP BY lang
), candidate AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM gram WHERE k > 1 AND f >= 10
), cut AS (
  SELECT *, array_to_string(ws[1 : c], ' ') AS first_part, array_to_string(ws[c + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidate)
), scored AS (
  SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut JOIN gram x ON x.lang = cut.lang AND x.phrase = first_part JOIN gram y ON y.lang = cut.lang AND y.phrase = rest
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), kept AS (
  SELECT w.* FROM weakest w WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS sub FROM candidate WHERE k = 3) s
    WHERE s.lang = w.lang AND s.sub = w.phrase AND 100 * s.a >= 50 * w.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= 2000""",
    "op12_prefix_trie": f"""WITH turn_rows AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unit) AS i, unit, bytes FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS unit,
           strlen(coalesce(text, '')) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id AS c, conv_id - conv_id % 5 AS p, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(CAST(conv_id AS VARCHAR), '')])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM turn_rows WHERE i = 1
), rebuilt AS (
  SELECT c, 0 AS part, i, unit, bytes FROM convs JOIN turn_rows ON turn_rows.conv_id = p AND i <= h
  UNION ALL SELECT c, 1, i, unit, bytes FROM convs JOIN turn_rows ON turn_rows.conv_id = c AND i > h
), path AS (
  SELECT c, 0 AS depth, '' AS prefix, 0 AS bytes FROM convs
  UNION ALL SELECT c, row_number() OVER w, sha256(string_agg(unit, '') OVER w), bytes FROM rebuilt
  WINDOW w AS (PARTITION BY c ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), ended AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends, lag(prefix) OVER (PARTITION BY c ORDER BY depth) AS before FROM path
), node AS (
  SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs, min(before) AS before, (count(*) - 1) * min(bytes) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM ended GROUP BY depth, prefix
), child AS (
  SELECT depth - 1 AS depth, before AS prefix, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN child USING (depth, prefix)
), subtree AS (
  SELECT a.depth, a.prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM counted n JOIN path a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN subtree USING (depth, prefix) LEFT JOIN node p ON p.depth = n.depth - 1 AND p.prefix = n.before""",
    "op9_chat_format": r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), ordered AS (
  SELECT *, lag(role) OVER w AS before FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS body,
         CASE WHEN before = role THEN 3
              ELSE 14 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) END AS frame
  FROM ordered
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + frame) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
}
