"""Thin queries: each applies its operator to a whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import new_dir, table

ALL: list = []
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        ALL.append(f)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s FROM w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query(JACCARD_SQL)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ngramjoin import ngram_join

    found, _ = ngram_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth,
             (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT min(nth) AS first FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, CASE WHEN nth >= (SELECT first FROM f) THEN least(cap, (SELECT level FROM l WHERE nth = (SELECT first FROM f)) * w) ELSE cap END AS target FROM l),
p AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS copies FROM t),
r AS (SELECT d.doc_id, d.size, d.h, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size <= rest AND (rest - (upto - size)) * 2 >= size)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


@query(MIX_SQL)
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
        FROM it, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM low, ns, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT dw.doc_id, dw.n, dw.i, win.item_id FROM dw JOIN win USING (n, k)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit)),
nh AS (SELECT doc_id, count(*)::BIGINT AS n_hit FROM words GROUP BY doc_id),
ni AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""


@query(DECONTAMINATION_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c.item_ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(c.item_ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((c.n_hit > 0) & (c.n_hit * 20 >= c.n_words)).alias("contaminated"),
    )


LINES_SQL = r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""


@query(LINES_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.linededup import drop_frequent_lines

    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = F.col("line_dedup")
    return out.select("doc_id", d.n_lines.alias("n_lines"), d.n_dropped.alias("n_dropped"), F.sha2(d.text_kept.cast("binary"), 256).alias("kept_sha256"))


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])' AS control FROM c),
f AS (SELECT *, length('<|im_start|>') + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), control, '\1\2\\\3', 'g')) + 1
             + length(regexp_replace(text, control, '\1\2\\\3', 'g')) + length('<|im_end|>') + 1 AS own,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
g AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY conv_id) AS n FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR i = n), 0)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""


@query(CHAT_SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.chat import digest, expand

    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(expand(own.unionByName(extra)))


@query()
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.tokens import read_tokens, write_tokens

    path = new_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("word_bpe_49k.json")), end_id=2)
    return read_tokens(spark, path)


@query()
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ann import nearest

    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import classify

    docs = table(spark, sf_dir, "documents")
    found = classify(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", "host", "path", "p_text", "p_site", "score", "keep")


@query()
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.htmltext import extract

    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
