"""The operators applied to the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stage_path
from . import bpe, fim, jaccard, knn, language, licences, lm, packing, pii, quality, rans, templates, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Documents as files of a source tree: folders by source, language and number; the shortest texts of a
# folder stand for its licence files.
PATH_SQL = """
concat(source, '/', lang, '/', CAST(floor(doc_id / 500) AS INT),
       CASE WHEN length(text) < 600 THEN '/LICENSE.' ELSE concat('/', CAST(doc_id % 5 AS STRING), '/') END, CAST(doc_id AS STRING))
"""


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.expr(PATH_SQL).alias("path"), "text")
    score = F.coalesce("licence_score", F.lit(0)).alias("licence_score")
    return licences.scan(files).select("doc_id", "licence", score, "licence_from")


def recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


LINES_SQL = rf"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM documents
), tokens AS (
    SELECT doc_id, place, list_transform(
        list_filter(string_split_regex(raw, '[ 	-
]+'), lambda w: w <> ''),
        lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{templates.WILD}' ELSE w END) AS t
    FROM lines
), usable AS (
    SELECT *, [CAST(len(t) AS VARCHAR)] || t[1:{templates.LEADING}] AS leaf FROM tokens
    WHERE len(t) >= {templates.MIN_TOKENS}
      AND 100 * len(list_filter(t, lambda w: w <> '{templates.WILD}')) >= {templates.MIN_CONSTANT} * len(t)
), kinds AS (SELECT DISTINCT leaf, t FROM usable
), broad AS (SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) > {templates.MAX_CHILDREN}
), wild AS (
    SELECT leaf, list(pos) AS wild FROM (
        SELECT leaf, pos FROM (
            SELECT DISTINCT leaf, unnest(t) AS value, generate_subscripts(t, 1) AS pos FROM kinds JOIN broad USING (leaf)
        ) GROUP BY leaf, pos HAVING count(*) > {templates.MAX_CHILDREN}
    ) GROUP BY leaf
), general AS (
    SELECT leaf, t, list_transform(t, lambda w, i: CASE WHEN list_contains(wild, i) THEN '{templates.WILD}' ELSE w END) AS g
    FROM kinds JOIN wild USING (leaf)
), placed AS (
    SELECT doc_id, place, coalesce(
        CASE WHEN 100 * len(list_filter(g, lambda w: w <> '{templates.WILD}')) >= {templates.MIN_CONSTANT} * len(g) THEN g END,
        u.t) AS template
    FROM usable u LEFT JOIN general ON u.leaf = general.leaf AND u.t = general.t
), firsts AS (
    SELECT template, min(doc_id) AS f FROM placed GROUP BY template HAVING min(doc_id) <> max(doc_id)
), gone AS (
    SELECT doc_id, place FROM placed JOIN firsts USING (template) WHERE doc_id <> f
)
SELECT doc_id, count(*) AS n_lines, count(g.place) AS n_dropped,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '')) AS text_md5
FROM lines l LEFT JOIN gone g USING (doc_id, place) GROUP BY doc_id
"""


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "tokens")
    rans.write(rans.token_rows(table(spark, sf_dir, "documents")), path)
    return rans.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])

    def listed(spans: str) -> Column:
        shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(shown, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id", *[count(kind) for kind in pii.BASE],
        F.sha2(listed("pii_base").cast("binary"), 256).alias("base_sha256"), listed("pii_spans").alias("spans"),
    )


def backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


BACKOFF_SQL = rf"""
WITH tokens AS (
    SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM (
        SELECT doc_id, list_filter(string_split_regex(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
        FROM documents)
), placed AS (
    SELECT *, lag(c) OVER d AS b, lag(c, 2) OVER d AS a FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), n AS (SELECT count(*) AS n FROM tokens
), own AS (SELECT doc_id, count(*) AS n_words FROM tokens GROUP BY doc_id
), c1 AS (SELECT doc_id, c, sum(count(*)) OVER (PARTITION BY c) - count(*) AS k FROM placed GROUP BY doc_id, c
), c2 AS (SELECT doc_id, b, c, sum(count(*)) OVER (PARTITION BY b, c) - count(*) AS k FROM placed WHERE b IS NOT NULL GROUP BY doc_id, b, c
), c3 AS (SELECT doc_id, a, b, c, sum(count(*)) OVER (PARTITION BY a, b, c) - count(*) AS k FROM placed WHERE a IS NOT NULL GROUP BY doc_id, a, b, c
), joined AS (
    SELECT p.doc_id, least(p.i - 1, 2) AS depth, greatest(1, n.n - own.n_words) AS rest,
           c3.k AS abc, ab.k AS ab, bc.k AS bc, b1.k AS kb, u.k AS kc
    FROM placed p CROSS JOIN n JOIN own USING (doc_id)
    JOIN c1 u ON u.doc_id = p.doc_id AND u.c = p.c
    LEFT JOIN c1 b1 ON b1.doc_id = p.doc_id AND b1.c = p.b
    LEFT JOIN c2 bc ON bc.doc_id = p.doc_id AND bc.b = p.b AND bc.c = p.c
    LEFT JOIN c2 ab ON ab.doc_id = p.doc_id AND ab.b = p.a AND ab.c = p.b
    LEFT JOIN c3 ON c3.doc_id = p.doc_id AND c3.a = p.a AND c3.b = p.b AND c3.c = p.c
), scored AS (
    SELECT doc_id, CASE WHEN abc > 0 THEN 3 WHEN bc > 0 THEN 2 WHEN kc > 0 THEN 1 ELSE 0 END AS level,
           CASE WHEN abc > 0 THEN CAST(abc AS DOUBLE) / ab
                WHEN bc > 0 THEN pow({lm.BACKOFF}, depth - 1) * (CAST(bc AS DOUBLE) / kb)
                WHEN kc > 0 THEN pow({lm.BACKOFF}, depth) * (CAST(kc AS DOUBLE) / rest)
                ELSE pow({lm.BACKOFF}, depth) / (rest + 1.0e0) END AS s
    FROM joined
)
SELECT d.doc_id, count(s) AS n_words, count(*) FILTER (WHERE level = 3) AS n_trigrams, count(*) FILTER (WHERE level = 2) AS n_bigrams,
       count(*) FILTER (WHERE level = 1) AS n_unigrams, count(*) FILTER (WHERE level = 0) AS n_unseen,
       CAST(coalesce(sum(round(1000 * ln(s))), 0) AS BIGINT) AS score_millinats
FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id
"""


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


NEAREST_SQL = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM rows q JOIN rows x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


JACCARD_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard.SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {jaccard.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {jaccard.SHINGLE - 1}], ' ')) END) AS g
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= {jaccard.PERCENT} * (x.n + y.n - k)
), reached AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(b) AS component_id
FROM reached LEFT JOIN sizes ON a = doc_id GROUP BY a
"""


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.words(table(spark, sf_dir, "documents"), drop_one_in=97))


VARIANTS_SQL = rf"""
WITH RECURSIVE counted AS (
    SELECT k, w, count(*) AS c FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
        FROM documents
    ) GROUP BY ALL
), crc_table AS (
    SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
               lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), coded AS (
    SELECT w, c, t, flatten(list_transform(string_split(k || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
               ELSE [CAST(192 | (unicode(x) >> 6) AS BIGINT), CAST(128 | (unicode(x) & 63) AS BIGINT)] END)) AS b
    FROM counted CROSS JOIN crc_table
), drawn AS (
    SELECT w, c, xor(list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h FROM coded
), words AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
        SELECT c, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM drawn
    ) WHERE length(word) >= {variants.MIN_LENGTH} GROUP BY word HAVING sum(c) >= {variants.MIN_COUNT}
), cut AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.d = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.d = b.word
), ranked AS (
    SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {variants.RATIO} * w.n THEN near END AS form,
           CASE WHEN near_n >= {variants.RATIO} * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON w.word = r.word AND r = 1
), walked AS (
    SELECT word, word AS at, form FROM formed
    UNION ALL SELECT w.word, f.word, f.form FROM walked w JOIN formed f ON w.form = f.word
)
SELECT f.word, f.form, w.at AS root, n, n_near, form_n FROM formed f JOIN walked w ON w.word = f.word AND w.form IS NULL
"""


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(table(spark, sf_dir, "documents")).withColumn("restored", fim.restored())
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")],
    )


MIDDLE_SQL = r"""
WITH given AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS d FROM documents
), drawn AS (
    SELECT *, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(d, CAST(1 + 8 * k AS INT), 8) AS UBIGINT)) AS h,
           regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u
    FROM given
), placed AS (
    SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
           coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix
    FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    draw = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # A fifth is held out of all learning; of the rest, a tenth calibrates and is kept from the gradient.
    found = language.identify(docs, draw % 5 != 0, F.floor(draw / 5) % 10 == 0)
    return found.select("doc_id", (draw % 5 == 0).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_licence_scan": (licence_scan, licences.sql(f"SELECT doc_id, {PATH_SQL} AS path, text FROM documents")),
    "op2_line_templates": (recurring_lines, LINES_SQL),
    "op3_pack_hilbert": (packed_documents, None),
    "op4_decision_list": (quality_rules, None),
    "op5_boosted_pii": (personal_data, None),
    "op6_stupid_backoff": (backoff_scores, BACKOFF_SQL),
    "op7_voronoi_topk": (nearest_vectors, NEAREST_SQL),
    "op8_byte_bpe": (byte_bpe, None),
    "op9_trie_jaccard": (jaccard_classes, JACCARD_SQL),
    "op10_rans_tokens": (token_files, None),
    "op11_trie_variants": (spelling_variants, VARIANTS_SQL),
    "op12_swar_fim": (fill_in_middle, MIDDLE_SQL),
    "op13_subword_language": (languages, None),
}
