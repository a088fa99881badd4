"""Classification and scoring of postings against vocabularies and saved profiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.geo import distance_bonus, haversine_km, tells_remote
from tidewell.functions.text import WORKPLACES, canonical, clean_html, first_match, has_phrase, has_term, matching_terms, near, normalize, phrases, place_key, within_context
from tidewell.sources.html import settled

#: Intents that satisfy a wanted one.
COMPATIBLE = {"internship": ("internship", "summer_internship", "co_op")}
#: Words of seniority that speak against early-career profiles.
SENIOR = ("senior", "sênior", "staff", "principal", "manager", "gerente", "director", "diretor", "lead", "líder", "head of", "vice president", "vp", "especialista")
CONTEXT_WIDTH, NEAR_WORDS = 180, 3


def detect_intents(title: Column, employment: Column, description: Column, terms: Mapping[str, Iterable[str]], anywhere: Mapping[str, Iterable[str]], structured: Column | None = None, structured_map: Mapping[str, Iterable[str]] | None = None) -> Column:
    """Intents in the order of evidence: a structured field, words of title and employment, telling phrases anywhere."""
    head = normalize(F.concat_ws(" ", title, employment))
    whole = normalize(F.concat_ws(" ", title, description, employment))
    found: list[Column] = []
    for value, intents in (structured_map or {}).items():
        found.append(F.when(F.lower(structured) == value, F.array(*map(F.lit, intents))))
    found += [F.when(has_term(head, list(t)), F.array(F.lit(i))) for i, t in terms.items()]
    found += [F.when(has_term(whole, list(t)), F.array(F.lit(i))) for i, t in anywhere.items()]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*found))))


@dataclass(frozen=True)
class Course:
    """Vocabulary of a course; all terms canonical."""

    direct: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    course: tuple[str, ...] = ()
    profession: tuple[str, ...] = ()
    weak_body: tuple[str, ...] = ()
    discipline: tuple[str, ...] = ()
    strong_score: int = 74
    #: phrases anywhere, or in the title, that cap the score below level 3
    cap_anywhere: tuple[tuple[str, ...], int] | None = None
    cap_title: tuple[tuple[str, ...], int] | None = None


def title_level(title: Column, course: Course, roles: Iterable[str]) -> Column:
    level = F.when(has_phrase(title, course.direct), 3)
    if course.discipline:
        level = level.when(near(title, course.discipline, roles, NEAR_WORDS), 3)
    return level.when(has_phrase(title, course.strong), 2).when(has_phrase(title, course.weak), 1).otherwise(0)


#: What is said about the affinity to a course; the score from which, and how much of it.
AFFINITY_REASONS = {
    "direct": "curso/profissão explícita no título",
    "strong": "especialidade fortemente ligada ao curso no título",
    "weak": "área relacionada no título",
    "education": "curso citado em requisito/formação",
    "profession": "profissão da área descrita na vaga",
    "course": "curso citado na descrição",
    "skills": "competências centrais da área na descrição",
}
REASONED_SCORE, MAX_REASONS = 35, 3


def affinity_scores(rows: DataFrame, courses: Mapping[str, Course], roles: Iterable[str], education: Iterable[str], title: str = "title", description: str = "description") -> DataFrame:
    """``rows`` with ``course_scores``, a map of every course to 0..100, and ``course_reasons``, a map of courses with at
    least 35 points to what tells for them: the title, the course in the text, skills in it.

    Cleaned texts, title levels and evidence are columns of their own stages, so that each is
    computed once for all courses.
    """
    names = list(courses)
    staged = rows.withColumns({"__title": clean_html(F.col(title)), "__body": clean_html(F.col(description))})
    staged = staged.withColumns({f"__level_{i}": title_level(F.col("__title"), courses[n], roles) for i, n in enumerate(names)})
    body = F.col("__body")
    evidence = {}
    for i, n in enumerate(names):
        c = courses[n]
        evidence |= {
            f"__strong_{i}": F.size(phrases(body, c.strong)), f"__weak_{i}": F.size(phrases(body, c.weak_body)), f"__course_{i}": has_phrase(body, c.course),
            f"__profession_{i}": has_phrase(body, c.profession), f"__education_{i}": within_context(body, c.course, education, CONTEXT_WIDTH),
        }
    staged = staged.withColumns(evidence)
    final, reasons = {}, {}
    for i, n in enumerate(names):
        c = courses[n]
        level, strong, weak, direct, profession, educated = (F.col(f"__{k}_{i}") for k in ("level", "strong", "weak", "course", "profession", "education"))
        score = F.when(level == 3, 94).when(level == 2, c.strong_score).when(level == 1, 46).otherwise(0)
        score = F.greatest(score, F.when(educated, 88).when(profession, 62).when(direct, 46).otherwise(0))
        score = F.greatest(score, F.when(strong > 0, F.least(F.lit(56), 28 + 7 * F.least(F.lit(4), strong))).otherwise(0))
        score = F.greatest(score, F.when(weak > 0, F.least(F.lit(18), 6 + 3 * F.least(F.lit(4), weak))).otherwise(0))
        told = (direct | profession).cast("int")
        score = (
            F.when((level >= 2) & ((told > 0) | (strong > 0)), F.least(F.lit(99), score + F.least(F.lit(5), 2 * told + strong)))
            .when((level == 1) & (strong > 0), F.least(F.lit(68), score + F.least(F.lit(8), 2 * strong)))
            .otherwise(score)
        )
        others = [F.col(f"__level_{j}") for j in range(len(names)) if j != i]
        other = F.greatest(F.lit(0), *others) if others else F.lit(0)
        score = F.when((level == 0) & (other >= 2) & ~educated, F.least(score, F.lit(28))).when((level == 1) & (other == 3) & ~educated, F.least(score, F.lit(48))).otherwise(score)
        if c.cap_anywhere:
            words, cap = c.cap_anywhere
            score = F.when((level < 3) & has_phrase(F.concat_ws(" ", "__title", "__body"), words), F.least(score, F.lit(cap))).otherwise(score)
        if c.cap_title:
            words, cap = c.cap_title
            score = F.when((level < 3) & has_phrase(F.col("__title"), words), F.least(score, F.lit(cap))).otherwise(score)
        score = F.when((level == 0) & ~educated & (score < 20), 0).otherwise(score)
        final[f"__score_{i}"] = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
        say = AFFINITY_REASONS
        why = [
            F.when(level == 3, say["direct"]).when(level == 2, say["strong"]).when(level == 1, say["weak"]), F.when(educated, say["education"]).when(profession, say["profession"]).when(direct, say["course"]),
            F.when((strong > 0) & (level == 0) & ~educated & ~profession, say["skills"]),
        ]
        reasons[n] = F.slice(F.array_compact(F.array(*why)), 1, MAX_REASONS)
    staged = staged.withColumns(final)
    entries = [F.when(F.col(f"__score_{i}") >= REASONED_SCORE, F.struct(F.lit(n).alias("key"), reasons[n].alias("value"))) for i, n in enumerate(names)]
    scores = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"__score_{i}"))))
    told = F.map_from_entries(F.filter(F.array_compact(F.array(*entries)), lambda e: F.size(e["value"]) > 0))
    # filters on the results stay above, where else they would compute all stages again below
    return settled(staged, [c for c in staged.columns if not c.startswith("__")], course_scores=scores, course_reasons=told)


@dataclass(frozen=True)
class Profile:
    """A saved search."""

    id: str
    courses: tuple[str, ...] = ()
    intents: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    workplaces: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    home: tuple[float, float] | None = None
    max_distance_km: float | None = None
    allow_unknown_distance: bool = True
    remote_ignores_distance: bool = True
    minimum_score: int = 45
    senior_words: tuple[str, ...] = field(default=SENIOR)


#: Points of a profile's parts.
COURSE_SHARE, NO_COURSE_SCORE, LEAST_COURSE_SCORE, STRONG_COURSE, PART_COURSE = 0.70, 55, 25, 70, 40
#: What is said about each part of a match.
REASONS = {
    "strong": "forte aderência ao curso",
    "part": "aderência parcial ao curso",
    "any_course": "sem filtro de curso",
    "intent": "tipo de oportunidade desejado",
    "no_intent": "tipo de oportunidade não confirmado",
    "include": "palavras-chave de interesse",
    "exclude": "contém palavra-chave excluída",
    "senior": "senioridade incompatível",
    "workplace": "modalidade desejada",
    "other_workplace": "modalidade fora da preferência",
    "abroad": "país fora da preferência",
    "country": "país desejado",
    "remote": "remoto: distância ignorada",
    "unknown": "distância desconhecida",
    "far": "fora do raio escolhido",
}


def _profile_match(p: Profile, at: int) -> Column:
    """Struct (profile_id, score, course_score, distance_km, eligible, reasons) over columns title, description, company,
    location, workplace_type, country, latitude, longitude, course_scores, detected_intents.

    A posting from another country than those wanted keeps the points that it has before place counts.
    """
    reasons: list[Column] = []
    say = lambda cond, reason: reasons.append(F.when(cond, REASONS[reason]))
    course, wanted = F.col(f"__course_{at}"), F.col(f"__wanted_{at}")
    # a product of doubles, cut: 90 * 0.7 gives 62
    score = (course.cast("double") * F.lit(COURSE_SHARE).cast("double")).cast("int") if p.courses else F.lit(NO_COURSE_SCORE)
    if p.courses:
        say(course >= STRONG_COURSE, "strong")
        say((course >= PART_COURSE) & (course < STRONG_COURSE), "part")
    else:
        say(F.lit(True), "any_course")
    if p.intents:
        score = score + F.when(wanted, 25).otherwise(-20)
        say(wanted, "intent")
        say(~wanted, "no_intent")
    n_in, n_out, senior = (F.col(f"__{k}_{at}") for k in ("in", "out", "senior"))
    score = score + F.least(F.lit(15), 5 * n_in) - F.least(F.lit(60), 30 * n_out) - F.when(senior, 50).otherwise(0)
    say(n_in > 0, "include")
    say(n_out > 0, "exclude")
    say(senior, "senior")
    place = F.col("__place")
    if p.workplaces:
        score = score + F.when(place.isin(*p.workplaces), 5).when(place != "unknown", -12).otherwise(0)
        say(place.isin(*p.workplaces), "workplace")
        say(~place.isin(*p.workplaces) & (place != "unknown"), "other_workplace")
    known = F.coalesce(F.col("country") != "", F.lit(False))
    abroad = known & ~F.col("country").isin(*p.countries) if p.countries else F.lit(False)
    if p.countries:
        score = score + F.when(known & ~abroad, 4).otherwise(0)
        say(abroad, "abroad")
        say(known & ~abroad, "country")
    remote = F.col("__remote") & F.lit(p.remote_ignores_distance)
    distance = F.when(remote, 0.0).otherwise(F.col(f"__away_{at}"))
    fits = F.lit(True)
    if p.max_distance_km is not None:
        inside = F.coalesce(distance <= p.max_distance_km, F.lit(p.allow_unknown_distance))
        fits = remote | inside
        near = ~remote & ~abroad & F.coalesce(distance <= p.max_distance_km, F.lit(False))
        score = score + F.when(near, distance_bonus(distance, p.max_distance_km)).otherwise(0)
        say(~abroad & remote, "remote")
        if not p.allow_unknown_distance:
            say(~abroad & ~remote & distance.isNull(), "unknown")
        say(~abroad & ~remote & (distance > p.max_distance_km), "far")
        reasons.append(F.when(near, F.concat(F.lit("dentro do raio ("), F.bround(distance, 0).cast("long").cast("string"), F.lit(" km)"))))
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    eligible = ~abroad & (n_out == 0) & fits & (score >= p.minimum_score)
    if p.courses:
        eligible &= course >= LEAST_COURSE_SCORE
    if p.intents:
        eligible &= wanted
    return F.struct(
        F.lit(p.id).alias("profile_id"), score.cast("int").alias("score"), course.cast("int").alias("course_score"), F.when(abroad, None).otherwise(F.bround(distance, 1)).alias("distance_km"),
        eligible.alias("eligible"), F.array_compact(F.array(*reasons)).alias("reasons"),
    )


def _evidence(p: Profile, at: int) -> dict[str, Column]:
    course = F.greatest(F.lit(0), *(F.coalesce(F.col("course_scores")[c], F.lit(0)) for c in p.courses)) if p.courses else F.lit(100)
    accepted = {a for w in p.intents for a in COMPATIBLE.get(w, (w,))}
    wanted = F.arrays_overlap(F.coalesce(F.col("detected_intents"), F.array().cast("array<string>")), F.array(*map(F.lit, sorted(accepted)))) if p.intents else F.lit(False)
    away = haversine_km(F.lit(p.home[0]), F.lit(p.home[1]), F.col("latitude"), F.col("longitude")) if p.home else F.lit(None).cast("double")
    found = {"in": F.size(matching_terms(F.col("__whole"), p.include)), "out": F.size(matching_terms(F.col("__whole"), p.exclude)), "senior": has_term(F.col("__title"), p.senior_words)}
    return {f"__{k}_{at}": c for k, c in {**found, "course": course, "wanted": wanted, "away": away}.items()}


def match_profiles(rows: DataFrame, profiles: Iterable[Profile], keys: list[str]) -> DataFrame:
    """One row for each posting and profile: an array of structs is exploded, so no join is needed. Texts and evidence are
    columns of stages of their own, so that each is computed once."""
    profiles = list(profiles)
    texts = {
        "__whole": normalize(F.concat_ws(" ", "title", "description", "company")), "__title": normalize(F.col("title")),
        "__place": normalize(F.concat_ws(" ", "workplace_type", "location", F.substring("description", 1, 600))), "__remote": place_key(F.concat_ws(" ", "location", "workplace_type", "title")),
    }
    staged = rows.withColumns(texts).withColumns({"__place": first_match(F.col("__place"), WORKPLACES, "unknown"), "__remote": tells_remote(F.col("__remote"))} | {k: c for at, p in enumerate(profiles) for k, c in _evidence(p, at).items()})
    return staged.select(*keys, F.explode(F.array(*(_profile_match(p, at) for at, p in enumerate(profiles)))).alias("m")).select(*keys, "m.*")


def query_plan(prefixes: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Distinct canonical "prefix term" queries of each profile, in order, at most ``limit`` (a feature of the plan)."""
    both = prefixes.join(terms, "profile_id").withColumn("query", canonical(F.concat_ws(" ", "prefix", "term")))
    first = both.groupBy("profile_id", "query").agg(F.min(F.struct("prefix_no", "term_no")).alias("at"))
    ranked = first.groupBy("profile_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "query"))), 1, limit).alias("q"))
    return ranked.select("profile_id", F.posexplode("q.query").alias("n", "query"))
