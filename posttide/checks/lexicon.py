"""Lexicon scores of documents and conversations.

The lexicon comes from the words of the ``benchmark`` table, with valences
computed from their letters; the modifier lists are words of the corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from posttide import testviews as v
from posttide.checks.shape import finish
from posttide.checks.text import sql_clean, sql_words
from posttide.functions import text as t
from posttide.operators import lexicon as lex

RULES = lex.Rules(
    boosters={"the": 0.293, "and": -0.293, "la": 0.293},
    booster_pairs={"in the": -0.293},
    negations=("of", "is", "de"),
    idioms={"on the": 1.5, "that in": -1.0},
    contrast="that",
)


def words_of_benchmark(spark, sf_dir):
    items = v.table(spark, sf_dir, "benchmark")
    words = items.select(
        F.explode(t.whitespace_tokens(t.clean_text(F.col("text")))).alias("token")
    ).distinct()
    valence = ((F.ascii("token") * 7 + F.length("token") * 13) % 41 - 20) / 10.0
    return words.filter(F.length("token") >= 4).select("token", valence.alias("valence"))


def _score(table: str, keys: list[str]):
    def query(spark, sf_dir):
        texts = v.texts(spark, sf_dir, table, *keys, "text").select(
            *keys, t.clean_text(F.col("text")).alias("cleaned_text")
        )
        return finish(lex.score_texts(texts, words_of_benchmark(spark, sf_dir), keys, rules=RULES))

    return query


def _label_counts(spark, sf_dir):
    scored = _score("documents", ["doc_id"])(spark, sf_dir)
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "lexicon_score": _score("documents", ["doc_id"]),
    "lexicon_score_conversations": _score("conversations", ["conv_id", "turn"]),
    "lexicon_label_counts": _label_counts,
}


def _in(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _booster(col: str) -> str:
    cases = " ".join(f"WHEN {col} = '{w}' THEN {b}" for w, b in RULES.boosters.items())
    return f"(CASE {cases} ELSE 0.0 END)"


def _sql(table: str, keys: list[str]) -> str:
    key = ", ".join(keys)
    neg = _in(RULES.negations)
    mods = _in(RULES.boosters)
    return f"""
WITH lexicon AS (
  SELECT token, ((ascii(token) * 7 + length(token) * 13) % 41 - 20) / 10.0 AS valence
  FROM (SELECT DISTINCT unnest({sql_words(sql_clean('text'))}) AS token FROM benchmark)
  WHERE length(token) >= 4),
d AS (SELECT {key}, {sql_words(sql_clean('text'))} AS words FROM {table}),
e AS (SELECT {key}, words, list_position(words, '{RULES.contrast}') AS contrast,
             unnest(range(1, len(words) + 1)) AS pos FROM d),
w AS (SELECT {key}, pos, contrast, words[pos] AS token,
             CASE WHEN pos > 1 THEN words[pos - 1] END AS p1,
             CASE WHEN pos > 2 THEN words[pos - 2] END AS p2,
             CASE WHEN pos > 3 THEN words[pos - 3] END AS p3,
             words[pos + 1] AS n1 FROM e),
j AS (SELECT w.*,
             CASE WHEN w.token IN ({mods}) OR (w.token = 'kind' AND coalesce(n1 = 'of', false))
                  THEN NULL ELSE l.valence END AS valence,
             l1.token IS NOT NULL AS in1, l2.token IS NOT NULL AS in2, l3.token IS NOT NULL AS in3,
             ln.token IS NOT NULL AS inn
      FROM w LEFT JOIN lexicon l ON l.token = w.token
             LEFT JOIN lexicon l1 ON l1.token = w.p1 LEFT JOIN lexicon l2 ON l2.token = w.p2
             LEFT JOIN lexicon l3 ON l3.token = w.p3 LEFT JOIN lexicon ln ON ln.token = w.n1),
v0 AS (SELECT *, CASE
         WHEN coalesce(p1 = 'no', false) OR coalesce(p2 = 'no', false)
              OR (coalesce(p3 = 'no', false) AND coalesce(p1 IN ('or', 'nor'), false))
           THEN valence * -0.74
         WHEN token = 'no' AND inn THEN 0.0 ELSE valence END::DOUBLE AS v FROM j
       WHERE valence IS NOT NULL),
v1 AS (SELECT * EXCLUDE (v), CASE WHEN p1 IS NULL OR in1 THEN v ELSE
         (v + CASE WHEN v < 0 THEN -{_booster('p1')} ELSE {_booster('p1')} END)
         * CASE WHEN p1 IN ({neg}) THEN -0.74 ELSE 1.0 END END::DOUBLE AS v FROM v0),
v2 AS (SELECT * EXCLUDE (v), CASE WHEN p2 IS NULL OR in2 THEN v ELSE
         (v + CASE WHEN v < 0 THEN -{_booster('p2')} * 0.95 ELSE {_booster('p2')} * 0.95 END)
         * CASE WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN 1.25
                WHEN p2 = 'without' AND p1 = 'doubt' THEN 1.0
                WHEN p2 IN ({neg}) THEN -0.74 ELSE 1.0 END END::DOUBLE AS v FROM v1),
v3 AS (SELECT * EXCLUDE (v), CASE WHEN p3 IS NULL OR in3 THEN v ELSE
         (v + CASE WHEN v < 0 THEN -{_booster('p3')} * 0.9 ELSE {_booster('p3')} * 0.9 END)
         * CASE WHEN (p3 = 'never' AND p2 IN ('so', 'this')) OR p1 IN ('so', 'this') THEN 1.25
                WHEN p3 = 'without' AND (p2 = 'doubt' OR p1 = 'doubt') THEN 1.0
                WHEN p3 IN ({neg}) THEN -0.74 ELSE 1.0 END END::DOUBLE AS v FROM v2),
v4 AS (SELECT * EXCLUDE (v), CASE WHEN p3 IS NULL OR in3 THEN v ELSE
         CASE WHEN token || ' ' || n1 = 'on the' THEN 1.5
              WHEN token || ' ' || n1 = 'that in' THEN -1.0
              WHEN p1 || ' ' || token = 'on the' OR p2 || ' ' || p1 = 'on the' THEN
                CASE WHEN p1 || ' ' || token = 'on the' THEN 1.5
                     WHEN p1 || ' ' || token = 'that in' THEN -1.0 ELSE 1.5 END
              WHEN p1 || ' ' || token = 'that in' OR p2 || ' ' || p1 = 'that in' THEN -1.0
              WHEN p3 || ' ' || p2 = 'on the' THEN 1.5
              WHEN p3 || ' ' || p2 = 'that in' THEN -1.0
              ELSE v END
         + CASE WHEN p3 || ' ' || p2 = 'in the' THEN -0.293 ELSE 0.0 END
         + CASE WHEN p2 || ' ' || p1 = 'in the' THEN -0.293 ELSE 0.0 END END::DOUBLE AS v FROM v3),
s AS (SELECT {key}, pos, v * CASE WHEN p1 = 'least' AND NOT in1
               AND coalesce(p2 NOT IN ('at', 'very'), true) THEN -0.74 ELSE 1.0 END
             * CASE WHEN contrast IS NULL OR contrast = 0 OR pos = contrast THEN 1.0
                    WHEN pos < contrast THEN 0.5 ELSE 1.5 END AS s FROM v4),
a AS (SELECT {key}, sum(s) AS total, count(*) FILTER (WHERE s <> 0) AS scored,
             coalesce(sum(s + 1.0) FILTER (WHERE s > 0), 0.0) AS p,
             coalesce(sum(1.0 - s) FILTER (WHERE s < 0), 0.0) AS n FROM s GROUP BY {key}),
t AS (SELECT {', '.join('d.' + k for k in keys)}, len(words) AS n_words,
             coalesce(total, 0.0) AS total, coalesce(p, 0.0) AS p, coalesce(n, 0.0) AS n,
             len(words) - coalesce(scored, 0) AS u
      FROM d LEFT JOIN a USING ({key})),
r AS (SELECT {key}, n_words,
        sign(total) * floor(abs(total / sqrt(total * total + 15.0)) * 10000.0 + 0.5) / 10000.0
          AS score,
        CASE WHEN n_words = 0 THEN 0.0 ELSE floor(n / (p + n + u) * 1000.0 + 0.5) / 1000.0 END
          AS neg,
        CASE WHEN n_words = 0 THEN 1.0 ELSE floor(u / (p + n + u) * 1000.0 + 0.5) / 1000.0 END
          AS neu,
        CASE WHEN n_words = 0 THEN 0.0 ELSE floor(p / (p + n + u) * 1000.0 + 0.5) / 1000.0 END
          AS pos FROM t)
SELECT {key}, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative'
              ELSE 'neutral' END AS label, score,
       CASE WHEN score >= 0.05 THEN pos WHEN score <= -0.05 THEN neg ELSE neu END AS confidence,
       neg, neu, pos FROM r"""


SQL = {
    "lexicon_score": _sql("documents", ["doc_id"]),
    "lexicon_score_conversations": _sql("conversations", ["conv_id", "turn"]),
    "lexicon_label_counts": f"""SELECT label, count(*) AS n
      FROM ({_sql("documents", ["doc_id"])}) GROUP BY label""",
}
