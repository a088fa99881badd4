"""Course affinity and profile matching over documents as postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.datasets import text_postings
from tidewell.operators import scoring
from tidewell.plans.base import query
from tidewell.plans.texts import _CANON, _NORM

#: A vocabulary of the documents' own words, in the shape of a course catalogue.
COURSES = {
    "letters": scoring.Course(direct=("the tion", "anner"), strong=("of the", "que"), weak=("and", "der"), course=("is the",), profession=("in the",), weak_body=("ing", "ent"), discipline=("reer",)),
    "numbers": scoring.Course(direct=("is and",), strong=("les", "und die"), weak=("the",), course=("la la",), profession=("de la",), weak_body=("con", "ich"), strong_score=68, cap_title=(("this",), 15)),
}
ROLES, EDUCATION = ("and", "the"), ("or",)


def _n(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join([f"CASE WHEN contains({text}, ' {t} ') THEN 1 ELSE 0 END" for t in terms] or ["0"]) + ")"


def _near(terms: tuple[str, ...]) -> str:
    at = lambda words: f"list_filter(range(1, len(w) + 1), lambda i: list_contains([{', '.join(repr(x) for x in words)}], w[i]))"
    return f"len(list_filter({at(terms)}, lambda a: len(list_filter({at(ROLES)}, lambda b: abs(a - b) <= 3)) > 0)) > 0" if terms else "FALSE"


def _around(terms: tuple[str, ...]) -> str:
    """Windows of 180 characters before and after, by position."""
    parts = [
        f"len(list_filter(range(1, CAST(length(b) AS BIGINT) + 1), lambda i: substr(b, i, {len(t) + 2}) = ' {t} ' AND contains(' ' || substr(b, greatest(1, i - 180), least(i - 1, 180) + {len(t) + 2} + 180) || ' ', ' {e} '))) > 0"
        for t in terms for e in EDUCATION
    ]
    return "(" + " OR ".join(f"(contains(b, ' {t} ') AND {p})" for t, p in zip(terms, parts, strict=True)) + ")"


def _levels() -> str:
    return ", ".join(
        f"CASE WHEN {_n('t', c.direct)} > 0 OR {_near(c.discipline)} THEN 3 WHEN {_n('t', c.strong)} > 0 THEN 2 WHEN {_n('t', c.weak)} > 0 THEN 1 ELSE 0 END AS level_{k}, {_n('b', c.strong)} AS strong_{k}, {_n('b', c.weak_body)} AS weak_{k}, "
        f"{_n('b', c.course)} > 0 AS course_{k}, {_n('b', c.profession)} > 0 AS profession_{k}, {_around(c.course)} AS education_{k}"
        for k, c in COURSES.items()
    )


def _score(k: str) -> str:
    c = COURSES[k]
    other = next(x for x in COURSES if x != k)
    base = f"""greatest(CASE level_{k} WHEN 3 THEN 94 WHEN 2 THEN {c.strong_score} WHEN 1 THEN 46 ELSE 0 END, CASE WHEN education_{k} THEN 88 WHEN profession_{k} THEN 62 WHEN course_{k} THEN 46 ELSE 0 END,
      CASE WHEN strong_{k} > 0 THEN least(56, 28 + 7 * least(4, strong_{k})) ELSE 0 END, CASE WHEN weak_{k} > 0 THEN least(18, 6 + 3 * least(4, weak_{k})) ELSE 0 END)"""
    told = f"CASE WHEN course_{k} OR profession_{k} THEN 1 ELSE 0 END"
    lifted = f"CASE WHEN level_{k} >= 2 AND ({told} > 0 OR strong_{k} > 0) THEN least(99, {base} + least(5, 2 * {told} + strong_{k})) WHEN level_{k} = 1 AND strong_{k} > 0 THEN least(68, {base} + least(8, 2 * strong_{k})) ELSE {base} END"
    capped = f"CASE WHEN level_{k} = 0 AND level_{other} >= 2 AND NOT education_{k} THEN least({lifted}, 28) WHEN level_{k} = 1 AND level_{other} = 3 AND NOT education_{k} THEN least({lifted}, 48) ELSE {lifted} END"
    if c.cap_title:
        capped = f"CASE WHEN level_{k} < 3 AND {_n('t', c.cap_title[0])} > 0 THEN least({capped}, {c.cap_title[1]}) ELSE {capped} END"
    return f"CASE WHEN level_{k} = 0 AND NOT education_{k} AND {capped} < 20 THEN 0 ELSE {capped} END"


_TEXTS = f"SELECT doc_id, source, ' ' || {_CANON.format('string_split(text, chr(10))[1]')} || ' ' AS t, ' ' || {_CANON.format('text')} || ' ' AS b, text, string_split(text, chr(10))[1] AS title, upper(lang) AS country FROM documents"
_SCORED = f"""WITH x AS ({_TEXTS}), y AS (SELECT *, string_split(trim(t), ' ') AS w FROM x), z AS (SELECT doc_id, text, title, country, t, {_levels()} FROM y),
s AS (SELECT doc_id, text, title, country, {', '.join(f'CAST({_score(k)} AS INTEGER) AS {k}' for k in COURSES)} FROM z)"""


def _scored(spark, sf_dir):
    return scoring.affinity_scores(text_postings(spark, sf_dir), COURSES, ROLES, EDUCATION)


@query(f"{_SCORED} SELECT doc_id, letters, numbers FROM s")
def affinity_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", *(F.col("course_scores")[k].alias(k) for k in COURSES))


def _why(k: str) -> str:
    say = {n: f"'{x}'" for n, x in scoring.AFFINITY_REASONS.items()}
    return f"""SELECT doc_id, '{k}' AS course, concat_ws('; ', CASE level_{k} WHEN 3 THEN {say['direct']} WHEN 2 THEN {say['strong']} WHEN 1 THEN {say['weak']} END, CASE WHEN education_{k} THEN {say['education']} WHEN profession_{k} THEN {say['profession']} WHEN course_{k} THEN {say['course']} END,
      CASE WHEN strong_{k} > 0 AND level_{k} = 0 AND NOT education_{k} AND NOT profession_{k} THEN {say['skills']} END) AS reasons FROM z WHERE {_score(k)} >= 35"""


@query(f"{_SCORED.replace('z AS (', 'z AS MATERIALIZED (')} SELECT * FROM ({' UNION ALL '.join(map(_why, COURSES))}) WHERE reasons <> ''")
def affinity_reasons(spark, sf_dir):
    """What tells for each course to which a posting has affinity."""
    return _scored(spark, sf_dir).select("doc_id", F.explode("course_reasons").alias("course", "reasons")).withColumn("reasons", F.array_join("reasons", "; "))


PROFILES = (
    scoring.Profile("strict", courses=("letters",), include=("idiot", "the"), exclude=("moron",), countries=("EN", "DE"), minimum_score=30),
    scoring.Profile("open", courses=(), include=("que",), exclude=("loser", "clown"), minimum_score=50),
)
_WORD = "CASE WHEN regexp_matches(n, '(^|[^\\p{{L}}\\p{{N}}_\\p{{M}}]){0}($|[^\\p{{L}}\\p{{N}}_\\p{{M}}])') THEN 1 ELSE 0 END"


def _profile_sql(p: scoring.Profile) -> str:
    course = f"greatest(0, {', '.join(p.courses)})" if p.courses else "100"
    base = f"CAST(trunc(CAST({course} AS DOUBLE) * 0.7) AS INTEGER)" if p.courses else "55"
    count = lambda words: "(" + " + ".join(_WORD.format(w) for w in words) + ")"
    home = f"CASE WHEN country IN ({', '.join(repr(c) for c in p.countries)}) THEN 4 ELSE 0 END" if p.countries else "0"
    abroad = f"country NOT IN ({', '.join(repr(c) for c in p.countries)})" if p.countries else "FALSE"
    score = f"greatest(0, least(100, {base} + least(15, 5 * {count(p.include)}) - least(60, 30 * {count(p.exclude)}) + {home}))"
    fits = f"AND {course} >= 25" if p.courses else ""
    return f"SELECT doc_id, '{p.id}' AS profile_id, {score} AS score, {course} AS course_score, NOT ({abroad}) AND {count(p.exclude)} = 0 AND {score} >= {p.minimum_score} {fits} AS eligible FROM m"


@query(f"{_SCORED}, m AS (SELECT *, {_NORM.format('title || chr(32) || text')} AS n FROM s) " + " UNION ALL ".join(map(_profile_sql, PROFILES)))
def profile_match(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumns({"company": F.lit(""), "location": F.lit(""), "workplace_type": F.lit(""), "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double"), "detected_intents": F.array().cast("array<string>")})
    return scoring.match_profiles(rows, PROFILES, ["doc_id"]).select("doc_id", "profile_id", "score", "course_score", "eligible")
