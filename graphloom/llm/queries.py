"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, jaccard, langid, licenses, mixing, packing, periodic, tokencount, topk, toxicity, vectordedup, warc
from .common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file: in $GRAPHLOOM_TOKENIZERS if set, else as installed."""
    if folder := os.environ.get("GRAPHLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.trainable(table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    score = F.col("__toxicity.score")
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), F.size("__toxicity.passages").alias("n_passages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.train(langid.trainable(docs.select("doc_id", "text", "lang")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    guess = F.col("__language")
    return langid.identify(docs.select("doc_id", "text"), models).select("doc_id", held.alias("held_out"), guess["lang"].alias("lang_pred"), guess["score"].alias("score"), guess["rejected"].alias("rejected"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(periodic.periodic_runs(periodic.with_cycles(table(spark, sf_dir, "documents"))))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    two = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(two)))


def queries() -> dict:
    return {
        "op1_best_fit_packing": op1,
        "op2_toxicity": op2,
        "op3_exact_topk": op3,
        "op4_token_counts": op4,
        "op5_ngram_jaccard_join": op5,
        "op6_license_scan": op6,
        "op7_language_id": op7,
        "op8_embedding_near_dedup": op8,
        "op9_warc": op9,
        "op10_source_mixing": op10,
        "op11_token_alignment": op11,
        "op12_periodic_runs": op12,
        "op13_chat_formatting": op13,
    }


def _op6_sql() -> str:
    """Sentences stand between hard ends (. ! ?, blank lines, ends of comments) and may run over soft ones
    (; : and line breaks): parts between soft ends are joined and looked up, the longest from each start."""
    number = {**{s: i for i, s in enumerate(licenses.SENTENCES, 1)}, **licenses.VARIANTS}
    known = ", ".join(f"('{s}', {i})" for s, i in number.items())
    marks = [(name, f",{','.join(map(str, seq))},") for name, seq in licenses.RULES]
    rules = []
    for name, mark in marks:
        line = "',' || ids || ','"
        for other, longer in marks:
            if other != name and longer != mark and longer.startswith(mark):
                line = f"replace({line}, '{longer}', ',')"
        rules.append(f"CASE WHEN contains({line}, '{mark}') THEN '{name}' END")
    steps = [f"n{k} AS (SELECT r, regexp_replace(t, '{slot}', '{filled}', 'g') AS t FROM n{k - 1})," for k, (slot, filled) in enumerate(licenses.SLOTS, 1)]
    slots = "\n".join(steps)
    names = ", ".join(f"('{old}', '{new}')" for old, new in licenses.EXPRESSED.items())
    return rf"""
WITH known(sentence, sid) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, translate(text, '{licenses.UPPER}' || chr(1) || chr(2), '{licenses.LOWER}  ') AS t FROM documents),
a AS (SELECT r, regexp_replace(regexp_replace(t, '\*/|-->', chr(1), 'g'), '\r\n', chr(10), 'g') AS t FROM docs),
b AS (SELECT r, regexp_replace(t, '[;:]*[.!?][.!?;:]*([ \t\r\n]|\z)', chr(1) || '\1', 'g') AS t FROM a),
c AS (SELECT r, regexp_replace(t, '[;:]+([ \t\r\n]|\z)', chr(2) || '\1', 'g') AS t FROM b),
d AS (SELECT r, regexp_replace(regexp_replace(t, '[\r\n][^a-z0-9\x01]*[\r\n]', chr(1), 'g'), '[\r\n]+', chr(2), 'g') AS t FROM c),
n0 AS (SELECT r, regexp_replace(t, '[^a-z0-9\x01\x02]+', ' ', 'g') AS t FROM d),
{slots}
u AS (SELECT r, unnest(string_split(t, chr(1))) AS s, unnest(range(length(t) - length(replace(t, chr(1), '')) + 1)) AS u FROM n{len(licenses.SLOTS)}),
p AS (SELECT r, u, list_transform(string_split(s, chr(2)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS ps FROM u),
i AS (SELECT r, u, ps, unnest(range(1, len(ps) + 1)) AS i FROM p),
e AS (SELECT r, u, i, sentence, sid, list_position(list_transform(range(i, len(ps) + 1), lambda j: array_to_string(list_filter(ps[i:j], lambda x: x <> ''), ' ')), sentence) AS k
      FROM i JOIN known ON ps[i] <> '' AND (sentence = ps[i] OR starts_with(sentence, ps[i] || ' '))),
f AS (SELECT r, u, i, max_by(sid, length(sentence)) AS sid, max_by(i + k, length(sentence)) AS stop FROM e WHERE k > 0 GROUP BY r, u, i),
g AS (SELECT *, max(stop) OVER (PARTITION BY r, u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM f),
seqs AS (SELECT r, string_agg(sid::VARCHAR, ',' ORDER BY u, i) AS ids FROM g WHERE upto IS NULL OR i >= upto GROUP BY r),
named AS (SELECT r, unnest(list_filter([{", ".join(rules)}], lambda x: x IS NOT NULL)) AS name FROM seqs),
meant(old, name) AS (VALUES {names}),
tags AS (SELECT r, unnest(regexp_extract_all(t, '{licenses.TAG}', 1)) AS e FROM docs),
parts AS (SELECT r, regexp_extract(unnest(string_split_regex(e, '{licenses.PARTS}')), '\A[ \t]*([a-z0-9.+-]+)', 1) AS old FROM tags),
places AS (SELECT r, unnest(regexp_extract_all(t, '{licenses.COMMONS}', 1)) AS p FROM docs),
told AS (SELECT r, name FROM named UNION SELECT r, name FROM parts JOIN meant USING (old)
         UNION SELECT r, CASE WHEN starts_with(p, 'public') THEN 'CC0-1.0' ELSE 'CC-' || upper(regexp_extract(p, 'licenses/([a-z-]+)/', 1)) || '-4.0' END FROM places),
lists AS (SELECT r, string_agg(name, ',' ORDER BY name) AS names FROM told GROUP BY r)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(names, '') AS licenses
FROM docs LEFT JOIN seqs USING (r) LEFT JOIN lists USING (r)"""


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, coalesce(len(s), 0) AS n FROM sh),
e AS (SELECT doc_id, hash(unnest(s)) AS h FROM sh),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e AS a JOIN e AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.b = both_ways.x)
SELECT n.doc_id, n.n AS n_shingles, c.m AS component_id FROM n JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) AS c ON c.a = n.doc_id"""

OP8_SQL = """
WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings),
v AS (SELECT r, vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM g
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y FROM v AS a JOIN v AS b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.9 * a.size * b.size),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
reach(a, b) AS (SELECT r, r FROM g UNION SELECT reach.a, l.y FROM reach JOIN l ON reach.b = l.x),
c AS (SELECT a, min(vec_id) AS m FROM reach JOIN g ON g.r = reach.b GROUP BY a)
SELECT g.vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, coalesce(g.vec_id = c.m, false) AS kept FROM g JOIN c ON c.a = g.r LEFT JOIN n ON n.x = g.r"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS b, sha1(h) AS g, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, b AS payload_bytes, g AS payload_digest,
       CASE WHEN b >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id <> last THEN last END AS refers_to FROM d"""

OP10_SQL = r"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality >= 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS w FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(w, 1.0::DOUBLE) AS w,
        (('0x' || substr(md5(doc_id::VARCHAR || '/mix'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents LEFT JOIN q USING (doc_id)),
k AS (SELECT doc_id, source, size, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM k GROUP BY source),
t AS (SELECT source, source_size, ([5, 2, 1])[((place - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS stop FROM s),
o AS (SELECT *, row_number() OVER r AS k, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM t WINDOW r AS (ORDER BY stop / weight, source ASC NULLS LAST)),
lv AS (SELECT arg_min(level, k) AS level FROM o WHERE level <= stop / weight),
g AS (SELECT source, source_size, least(stop, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM t LEFT JOIN lv ON true),
e AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
p AS (SELECT doc_id, size, source_size, target, epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + (CASE WHEN upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END)) * size)::BIGINT AS taken FROM p"""


#: Turns with their tokens and formatted length; windows by the running sum of tokens, then what each repeats.
OP13_SQL = rf"""
WITH raw AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, md5(text) AS digest, len(regexp_extract_all(text, '{chat.TOKEN}')) + {chat.MARKS} AS tokens,
             length(regexp_replace(role, '([<\[])(\\*)({chat._REST})', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)({chat._REST})', '\1\\\2\3', 'g'))
             + {len(chat.BEGIN + chat.MIDDLE + chat.END)} AS chars FROM raw),
o AS (SELECT *, row_number() OVER w AS nr, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) - tokens AS before FROM m
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn IS NULL, turn, role, digest)),
t AS (SELECT *, floor(before / {chat.BUDGET - chat.HISTORY - chat.RETAINED}.0)::BIGINT AS cell, nr = 1 AND role = '{chat.SYSTEM}' AND tokens <= {chat.RETAINED} AS system FROM o),
c AS (SELECT *, count(*) OVER k AS n, sum(tokens) OVER k AS cell_tokens, max(nr) OVER k AS last_nr, max(before + tokens) OVER k AS stop FROM t WINDOW k AS (PARTITION BY conv_id, cell)),
h AS (SELECT *, CASE WHEN nr = last_nr AND n > 1 AND stop > (cell + 1) * {chat.BUDGET - chat.HISTORY - chat.RETAINED} AND cell_tokens > {chat.BUDGET - chat.HISTORY - chat.RETAINED} THEN 1 ELSE 0 END AS half FROM c),
s AS (SELECT conv_id, cell, half, min(before) AS start, sum(tokens) AS tokens FROM h GROUP BY conv_id, cell, half),
y AS (SELECT conv_id AS y_id, tokens AS y_tokens FROM t WHERE system),
r AS (SELECT s.conv_id, s.start, greatest(0, least({chat.HISTORY}, {chat.BUDGET} - s.tokens - CASE WHEN s.start > 0 THEN coalesce(y_tokens, 0) ELSE 0 END)) AS room
      FROM s LEFT JOIN y ON y_id IS NOT DISTINCT FROM s.conv_id),
again AS (SELECT r.conv_id, sum(t.chars) AS chars FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.before < r.start AND (t.system OR t.before >= r.start - r.room) GROUP BY r.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = '{chat.TARGET}'), '') AS loss, sum(chars)::BIGINT AS chars FROM t GROUP BY conv_id)
SELECT d.conv_id, d.n_turns, d.turns_sha256, length(d.loss) AS loss_chars, sha256(d.loss) AS loss_sha256, (d.chars + coalesce(again.chars, 0))::BIGINT AS formatted_chars
FROM d LEFT JOIN again ON again.conv_id IS NOT DISTINCT FROM d.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_topk": OP3_SQL,
        "op5_ngram_jaccard_join": OP5_SQL,
        "op6_license_scan": _op6_sql(),
        "op8_embedding_near_dedup": OP8_SQL,
        "op9_warc": OP9_SQL,
        "op10_source_mixing": OP10_SQL,
        "op13_chat_formatting": OP13_SQL,
    }
