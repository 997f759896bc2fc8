"""SQL for DuckDB that gives the rows of the corpus queries by plain definitions: all pairs, all windows,
whole shingle sets and a recursion for components. They are for tables of a test's size."""

from __future__ import annotations

from .mixing import WEIGHTS
from .quality import CUTOFFS

#: The words of a text, none for null; `[^ -]` spells the contract's class for RE2.
WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

#: The end of an oracle on pairs: `links (a, b)` both ways between rows `n` of `rows`, to the least id reached.
COMPONENTS = """
reached AS (
    SELECT a AS n, a AS m FROM links
    UNION
    SELECT r.n, l.b AS m FROM reached r JOIN links l ON l.a = r.m
)"""

NEAR_VECTORS = f"""
WITH RECURSIVE vectors AS (
    SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS v FROM embeddings
), scaled AS (
    SELECT n, vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM vectors
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), usable AS (
    SELECT * FROM scaled WHERE size > 0
), links AS (
    SELECT a.n AS a, b.n AS b FROM usable a JOIN usable b ON a.n <> b.n AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9
), {COMPONENTS}, least AS (
    SELECT r.n, min(x.vec_id) AS component_id FROM reached r JOIN vectors x ON x.n = r.m GROUP BY r.n
), counts AS (
    SELECT a AS n, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM vectors LEFT JOIN counts USING (n) LEFT JOIN least USING (n)
"""

#: The checksum is the usual reflected one, a byte at a time over a table of 256 remainders.
CRC_TABLE = """
crc_table AS (
    SELECT list(r ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
        FROM (SELECT unnest(range(256)) AS b)
    )
)"""


def crc32_sql(text: str) -> str:
    """The checksum of a text's bytes; `crc_table` is in scope."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of letters, digits and what is no ASCII.
PLAIN_WORDS = rf"coalesce(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

CONTAMINATION = f"""
WITH docs AS (
    SELECT row_number() OVER () AS n, doc_id, {PLAIN_WORDS} AS w FROM documents
), items AS (
    SELECT item_id, {PLAIN_WORDS} AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + 9], ' ') AS content
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT size FROM item_windows
), doc_windows AS (
    SELECT n, size, p, array_to_string(w[p:p + size - 1], ' ') AS content
    FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, sizes WHERE len(w) >= size)
), met AS (
    SELECT n, size, p, item_id FROM doc_windows JOIN item_windows USING (size, content)
), hit AS (
    SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT n, unnest(range(p, p + size)) AS p FROM met) GROUP BY n
), named AS (
    SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM met) GROUP BY n
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (n) LEFT JOIN named USING (n)
"""

#: Near words have a deletion in common: both of one place, or one of the longer word alone.
SPELLING = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
    SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
    SELECT run, c, {crc32_sql("doc_id || ':' || run")} AS h FROM runs, crc_table
), words AS (
    SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), shortened AS (
    SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM shortened a JOIN shortened b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT s.word, s.n, w.word, w.n FROM shortened s JOIN words w ON w.word = s.rest
    UNION SELECT w.word, w.n, s.word, s.n FROM shortened s JOIN words w ON w.word = s.rest
), counted AS (
    SELECT word, count(*) AS n_near FROM near GROUP BY word
), formed AS (
    SELECT word, other AS form, m AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near) WHERE place = 1 AND m >= 10 * n
), way AS (
    SELECT word, form AS root FROM formed
    UNION ALL
    SELECT w.word, f.form FROM way w JOIN formed f ON f.word = w.root
), ends AS (
    SELECT word, root FROM way WHERE root NOT IN (SELECT word FROM formed)
)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN counted USING (word) LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)
"""

RESAMPLING = f"""
WITH {CRC_TABLE}, docs AS (
    SELECT row_number() OVER () AS n, doc_id, {PLAIN_WORDS} AS w FROM documents
), found AS (
    SELECT n, word, count(*) AS c FROM (SELECT n, unnest(w) AS word FROM docs) GROUP BY ALL
), aimed AS (
    SELECT word, count(*) AS c FROM (SELECT unnest({PLAIN_WORDS}) AS word FROM benchmark) GROUP BY word
), bucketed AS (
    SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM found UNION SELECT word FROM aimed), crc_table
), counts AS (
    SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT word, c AS s, 0 AS t FROM found UNION ALL SELECT word, 0, c FROM aimed) JOIN bucketed USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), sums AS (
    SELECT n, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS gain FROM found JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY n
), weighed AS (
    SELECT doc_id, n_features, CASE WHEN n_features > 0 THEN (gain - ((gain % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight
    FROM (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(gain, 0) AS gain FROM docs LEFT JOIN sums USING (n))
), scored AS (
    SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS docs FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 10 * docs // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
"""

SHARDS = """
WITH crc_table AS (
    SELECT list(r ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
        FROM (SELECT unnest(range(256)) AS b)
    )
), bytes AS (
    SELECT doc_id, source, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents
), sized AS (
    SELECT doc_id, source, len(h) + 16 AS size,
           xor(list_reduce(list_prepend(4294967295, list_transform(h, lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM bytes, crc_table
), keyed AS (
    SELECT *, md5(concat_ws(':', 'shard', doc_id, text_crc32, size)) AS k FROM sized
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY source ORDER BY k, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM keyed
), placed AS (
    SELECT *, row_number() OVER (ORDER BY fraction, k, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM ranked
), dealt AS (
    SELECT *, (place * 40 // n)::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""

MIX = rf"""
WITH sized AS (
    SELECT doc_id, source, len({WORDS}) AS size FROM documents
), per_source AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS place
    FROM sized GROUP BY source
), weighed AS (
    SELECT source, source_size, [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][place] AS weight, source_size * 3.0::DOUBLE AS most FROM per_source
), open AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left,
           row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place_by_rate
    FROM weighed WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levelled AS (
    SELECT arg_min(words_left / weight_left, place_by_rate) AS level FROM open WHERE words_left / weight_left <= most / weight
), targets AS (
    SELECT source, source_size, least(most, level * weight) AS target, CASE WHEN source_size > 0 THEN least(most, level * weight) / source_size ELSE 0 END AS rate
    FROM weighed, levelled
)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + (('0x' || substr(md5(concat_ws(':', 'mix', doc_id)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate))::INTEGER) * size)::BIGINT AS taken
FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
"""

#: Documents with equal sets are one node, so that copies are not paired with one another.
NEAR_TEXTS = rf"""
WITH RECURSIVE worded AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents
), placed AS (
    SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM worded WHERE len(w) >= 5
), shingled AS (
    SELECT row_id, word || ' ' || lead(word, 1) OVER doc || ' ' || lead(word, 2) OVER doc || ' ' || lead(word, 3) OVER doc || ' ' || lead(word, 4) OVER doc AS shingle
    FROM placed WINDOW doc AS (PARTITION BY row_id ORDER BY p)
), long_sets AS (
    SELECT row_id, list(shingle ORDER BY shingle) AS found FROM (SELECT DISTINCT row_id, shingle FROM shingled WHERE shingle IS NOT NULL) GROUP BY row_id
), sets AS (
    SELECT row_id, doc_id, CASE WHEN len(w) >= 5 THEN found WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles
    FROM worded LEFT JOIN long_sets USING (row_id)
), nodes AS (
    SELECT row_number() OVER () AS n, shingles, len(shingles) AS size, min(doc_id) AS first_id FROM sets WHERE len(shingles) > 0 GROUP BY shingles
), each AS (
    SELECT n, size, unnest(shingles) AS shingle FROM nodes
), links AS (
    SELECT a.n AS a, b.n AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.n <> b.n
    GROUP BY a.n, b.n, a.size, b.size HAVING 100 * count(*) >= 75 * (a.size + b.size - count(*))
), {COMPONENTS}, least AS (
    SELECT r.n, min(x.first_id) AS first_id FROM reached r JOIN nodes x ON x.n = r.m GROUP BY r.n
)
SELECT doc_id, len(s.shingles) AS n_shingles, coalesce(least.first_id, nodes.first_id, doc_id) AS component_id
FROM sets s LEFT JOIN nodes ON nodes.shingles = s.shingles LEFT JOIN least ON least.n = nodes.n
"""

WITHOUT_REPEATS = rf"""
WITH worded AS (
    SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, {WORDS} AS w FROM documents
), placed AS (
    SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM worded
), windows AS (
    SELECT n, p, array_to_string(w[p:p + 19], ' ') AS content FROM (SELECT n, w, unnest(range(1, len(w) - 18)) AS p FROM worded WHERE len(w) >= 20)
), seen AS (
    SELECT n, p, row_number() OVER (PARTITION BY content ORDER BY n, p) > 1 AS again FROM windows
), judged AS (
    SELECT n, p, word, coalesce(bool_or(again) OVER (PARTITION BY n ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
    FROM placed LEFT JOIN seen USING (n, p)
), summed AS (
    SELECT n, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
    FROM judged GROUP BY n
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM worded LEFT JOIN summed USING (n)
"""


def quality_sql(alpha: float = 0.01, delta: float = 0.05) -> str:
    """The base measures word by word, and each cutoff's binomial tail summed term by term."""
    cuts = ", ".join(f"('{m}', {j}, {cut}::DOUBLE)" for m, cuts in CUTOFFS.items() for j, cut in enumerate(cuts))
    shares = " UNION ALL ".join(f"SELECT n, '{m}' AS rule, {m} AS share FROM measured" for m in CUTOFFS)
    return rf"""
WITH worded AS (
    SELECT row_number() OVER () AS n, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), placed AS (
    SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM worded
), grams AS (
    SELECT n, p, word || ' ' || lead(word, 1) OVER doc || ' ' || lead(word, 2) OVER doc AS gram FROM placed WINDOW doc AS (PARTITION BY n ORDER BY p)
), twice AS (
    SELECT n, p FROM (SELECT n, p, count(*) OVER (PARTITION BY n, gram) AS times FROM grams WHERE gram IS NOT NULL) WHERE times > 1
), repeated AS (
    SELECT n, count(DISTINCT p) AS n_repeat_words FROM (SELECT n, unnest([p, p + 1, p + 2]) AS p FROM twice) GROUP BY n
), parts AS (
    SELECT n, doc_id, lang, w, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM worded
), base AS (
    SELECT n, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM parts LEFT JOIN repeated USING (n)
), measured AS (
    SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
           CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length
    FROM base
), shares AS ({shares}), cuts (rule, step, cutoff) AS (VALUES {cuts}), marks AS (
    SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), holdout AS (
    SELECT n, lang, quality FROM base JOIN marks USING (doc_id) WHERE quality IN (0, 1)
), strata AS (
    SELECT count(*) AS n_strata FROM (SELECT DISTINCT lang FROM holdout)
), counts AS (
    SELECT lang, rule, step, cutoff, count(*) FILTER (WHERE quality = 1) AS n_good, count(*) FILTER (WHERE quality = 0) AS n_bad,
           count(*) FILTER (WHERE quality = 1 AND share > cutoff) AS good, count(*) FILTER (WHERE quality = 0 AND share > cutoff) AS bad
    FROM holdout JOIN shares USING (n) JOIN cuts USING (rule) GROUP BY lang, rule, step, cutoff
), tails AS (
    SELECT *, list_sum(list_transform(range(good + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({alpha}) + (n_good - i) * ln(1 - {alpha})))) AS tail
    FROM counts
), tested AS (
    SELECT *, bool_and(n_good > 0 AND tail <= {delta} / (n_strata * {len(CUTOFFS)})) OVER (PARTITION BY lang, rule ORDER BY step) AS certified FROM tails, strata
), chosen AS (
    SELECT lang, rule, min(cutoff) AS cutoff FROM tested WHERE certified AND bad * n_good > good * n_bad GROUP BY lang, rule
), rejected AS (
    SELECT DISTINCT n FROM base JOIN shares USING (n) JOIN chosen ON chosen.lang IS NOT DISTINCT FROM base.lang AND chosen.rule = shares.rule AND share > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n NOT IN (SELECT n FROM rejected) AS kept
FROM base
"""


ORACLES = {
    "op2_embedding_near_dedup": NEAR_VECTORS,
    "op3_sharding": SHARDS,
    "op5_quality_rules": quality_sql(),
    "op6_mixing": MIX,
    "op7_ngram_jaccard_join": NEAR_TEXTS,
    "op10_substring_dedup": WITHOUT_REPEATS,
    "op11_decontamination": CONTAMINATION,
    "op12_spelling_variants": SPELLING,
    "op13_importance_resampling": RESAMPLING,
}
