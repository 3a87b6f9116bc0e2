"""From persona fields to tags and behaviour, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .identity import hash_fraction

# Coarse vocabularies, bins and coefficients that results depend on.
TRAITS = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")
AGE_TAGS = ((17, "age:under-18"), (24, "age:18-24"), (44, "age:25-44"), (64, "age:45-64"), (200, "age:65+"))
EDUCATION = {
    "primary": ["no schooling", "primary", "elementary", "ensino fundamental", "no qualifications"],
    "secondary": ["middle", "high school", "ensino médio", "ensino medio", "associate", "gcse", "apprenticeship", "a level", "ohne beruflichen bildungsabschluss", "berufsausbildung"],
    "tertiary": ["bachelor", "ensino superior", "graduação", "graduacao", "master", "doctor", "phd", "postgraduate", "pós-graduação", "pos-graduacao", "higher education", "fachschul"],
}
#: (words in an occupation, family, interests); the first that is found decides.
OCCUPATIONS = (
    ("teacher", "teacher", ["interest:literature", "interest:history"]),
    ("professor docente", "teacher", ["interest:literature"]),
    ("student estudante", "student", ["interest:literature"]),
    ("nurse enfermeir doctor médico medico", "healthcare", ["interest:health"]),
    ("entrepreneur empresári empreendedor self-employed shopkeeper comerciante", "small-business", []),
    ("engineer engenheir", "engineering", ["interest:geography"]),
    ("farmer agricultor", "agriculture", ["interest:geography"]),
    ("journalist jornalista", "media", ["interest:history", "interest:literature"]),
    ("musician músic artist artista", "arts", ["interest:music"]),
    ("writer escritor", "arts", ["interest:literature"]),
    ("retired aposentad", "retired", []),
    ("homemaker housewife dona_de_casa", "homemaker", []),
    ("kinderpfleger erzieher", "teacher", ["interest:education"]),
    ("lehrer", "teacher", ["interest:literature", "interest:history"]),
    ("krankenpfleg altenpfleg gesundheitspfleg heilerziehungspfleg behindertenpfleg pflegefach pflegeassist pflegehelf pflegedienst _pflege schwester nachtwache ärzt arzt", "healthcare", ["interest:health"]),
    ("unternehmer", "small-business", []),
    ("ingenieur", "engineering", ["interest:geography"]),
    ("landwirt", "agriculture", ["interest:geography"]),
    ("musiker künstler", "arts", ["interest:music"]),
    ("schriftsteller", "arts", ["interest:literature"]),
)
# Regions by locale, each with the names and codes of the places in it.
REGIONS = {
    "pt_BR": {
        "north": "AM Amazonas, PA Pará, AC Acre, RO Rondônia, RR Roraima, AP Amapá, TO Tocantins",
        "northeast": "BA Bahia, PE Pernambuco, CE Ceará, MA Maranhão, PB Paraíba, RN Rio Grande do Norte, AL Alagoas, SE Sergipe, PI Piauí",
        "central-west": "GO Goiás, MT Mato Grosso, MS Mato Grosso do Sul, DF Distrito Federal",
        "southeast": "SP São Paulo, RJ Rio de Janeiro, MG Minas Gerais, ES Espírito Santo",
        "south": "RS Rio Grande do Sul, SC Santa Catarina, PR Paraná",
    },
    "en_GB": {
        "england": "North East, North West, Yorkshire and the Humber, East Midlands, West Midlands, East of England, London, South East, South West",
        "scotland": "Scotland",
        "wales": "Wales",
        "northern-ireland": "Northern Ireland",
    },
    "de_DE": {
        "baden-wuerttemberg": "Baden-Württemberg", "bayern": "Bayern", "berlin": "Berlin", "brandenburg": "Brandenburg", "bremen": "Bremen", "hamburg": "Hamburg", "hessen": "Hessen",
        "mecklenburg-vorpommern": "Mecklenburg-Vorpommern", "niedersachsen": "Niedersachsen", "nordrhein-westfalen": "Nordrhein-Westfalen", "rheinland-pfalz": "Rheinland-Pfalz",
        "saarland": "Saarland", "sachsen": "Sachsen", "sachsen-anhalt": "Sachsen-Anhalt", "schleswig-holstein": "Schleswig-Holstein", "thueringen": "Thüringen",
    },
}
BROAD_TAGS = ("region:any", "age:any", "interest:geography", "interest:history")
HIGH_EDUCATION = ("master", "doctor", "phd", "bachelor", "graduate", "university")
LOW_EDUCATION = ("illiterate", "no_formal", "less_than", "below_primary")
TECH_WORDS = ("software", "computer", "programmer", "developer", "database")
STYLES = {"confrontational": (2, 2.0), "frustrated": (1, 1.5), "impatient": (0, 1.5), "neutral": (0, 1.0), "cooperative": (0, 0.3)}


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def ocean(raw: Column) -> Column:
    """A trait as 0..1: a T-score from a JSON object, (t - 20) / 60 with 50 where it has none; else a plain number; else 0.5."""
    score = F.coalesce(F.get_json_object(raw, "$.t_score").try_cast("double"), F.lit(50.0))
    return F.when(F.trim(raw).startswith("{") & F.get_json_object(raw, "$").isNotNull(), clamp((score - 20) / 60)).otherwise(F.coalesce(clamp(raw.try_cast("double")), F.lit(0.5)))


def ocean_label(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(raw, "$.label"), F.lit("?"))


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def education_ordinal(education: Column) -> Column:
    """0.8 for higher education words, 0.1 for words of none, else 0.5."""
    e = F.lower(F.coalesce(education, F.lit("")))
    return F.when(_any(e, HIGH_EDUCATION), 0.8).when(_any(e, LOW_EDUCATION), 0.1).otherwise(0.5)


def is_tech_occupation(occupation: Column) -> Column:
    words = F.split(F.lower(F.trim(F.coalesce(occupation, F.lit("")))), r"[_\s,/]+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in TECH_WORDS]))


def tech_literacy(education: Column, occupation: Column, age: Column) -> Column:
    ed, a = education_ordinal(education), age.try_cast("int")
    by_education = F.when(ed >= 0.7, 0.15).when(ed <= 0.15, -0.2).otherwise(0.0)
    by_age = F.when(a > 75, -0.25).when(a > 60, -0.15).when(a < 30, 0.1).otherwise(0.0)
    return clamp(0.5 + by_education + F.when(is_tech_occupation(occupation), 0.25).otherwise(0.0) + by_age)


def behaviour(traits: dict[str, Column], education: Column, occupation: Column, age: Column) -> dict[str, Column]:
    """patience, verbosity, cooperativeness, tech_literacy and error_proneness (0..1), from trait scores of 0..1."""
    tech = tech_literacy(education, occupation, age)
    return {
        "patience": clamp(0.5 + 0.3 * traits["agreeableness"] - 0.3 * traits["neuroticism"]),
        "verbosity": clamp(0.3 + 0.35 * traits["extraversion"] + 0.2 * traits["openness"]),
        "cooperativeness": clamp(0.3 + 0.5 * traits["agreeableness"] + 0.1 * traits["conscientiousness"]),
        "tech_literacy": tech,
        "error_proneness": clamp(0.3 + F.when(education_ordinal(education) <= 0.15, 0.3).otherwise(0.0) + F.when(tech < 0.3, 0.2).otherwise(0.0)),
    }


def interaction_style(agreeableness: Column, neuroticism: Column, patience: Column) -> Column:
    """The style by thresholds; patience counts with two digits."""
    patience = F.round(patience, 2)
    return (
        F.when((neuroticism > 0.6) & (agreeableness < 0.45), "confrontational")
        .when((neuroticism > 0.5) & (patience < 0.45), "frustrated")
        .when((agreeableness < 0.45) | (patience < 0.4), "impatient")
        .when((agreeableness > 0.6) & (neuroticism < 0.4), "cooperative")
        .otherwise("neutral")
    )


def frustration_level(style: Column, turn: Column, failures: Column, patience: Column, max_turns: int = 3) -> Column:
    """0 to 3: the style's base, its rate for each failure from the second on, half a point for late turns."""
    pick = lambda k: F.coalesce(F.element_at(F.create_map(*[x for s, v in STYLES.items() for x in (F.lit(s), F.lit(float(v[k])))]), style), F.lit(float(STYLES["neutral"][k])))
    middle, late = max(1, int(max_turns * 0.4)), max(2, int(max_turns * 0.7))
    total = pick(0) + F.when(failures >= 2, failures * pick(1)).otherwise(0.0) + F.when((turn >= middle) & (patience < 0.5), 0.5).otherwise(0.0) + F.when(turn >= late, 0.5).otherwise(0.0)
    return F.least(F.greatest(F.floor(total), F.lit(0)), F.lit(3)).cast("int")


def disclosure_style(key: Column, incremental: float = 0.6, seed: int = 0) -> Column:
    return F.when(hash_fraction(key, seed=seed) < incremental, "incremental").otherwise("upfront")


def persona_tags(age: Column, education: Column, occupation: Column, region: Column | None = None) -> Column:
    """The sorted tags of a persona: broad ones always, then region, age bin, education (longest word first) and occupation family (first match)."""
    a = age.try_cast("int")
    age_tag = F.lit(None).cast("string")
    for upper, tag in reversed(AGE_TAGS):
        age_tag = F.when((a >= 0) & (a <= upper), tag).otherwise(age_tag)
    e = F.lower(F.trim(education))
    level = F.lit(None).cast("string")
    for word, name in sorted(((w, n) for n, ws in EDUCATION.items() for w in ws), key=lambda x: len(x[0])):
        level = F.when(F.contains(e, F.lit(word)), f"education:{name}").otherwise(level)
    o = F.lower(F.trim(occupation))
    work = F.expr("array()").cast("array<string>")
    for words, family, interests in reversed(OCCUPATIONS):
        work = F.when(_any(o, [w.replace("_", " ") for w in words.split()]), F.array(F.lit(f"occupation-family:{family}"), *[F.lit(i) for i in interests])).otherwise(work)
    single = [F.lit(t) for t in BROAD_TAGS] + [age_tag, level] + ([F.concat(F.lit("region:"), F.lower(F.trim(region)))] if region is not None else [])
    tags = F.concat(F.filter(F.array(*single), lambda t: t.isNotNull()), work)
    return F.array_sort(F.array_distinct(tags))


def persona_text(**fields: Column) -> Column:
    """``label: value`` lines of the fields that have one."""
    parts = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{k.replace('_', ' ')}: "), F.trim(v.cast("string")))) for k, v in fields.items()]
    return F.concat_ws("\n", *parts)


def location_text(*parts: Column) -> Column:
    """Parts that aren't blank, each once, joined by commas."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[F.trim(p.cast("string")) for p in parts]), lambda p: p.isNotNull() & (p != ""))), ", ")


def place_name(name: Column) -> Column:
    """A place's name as it's compared: lower case, without accents, one space between words."""
    accents = "áàâãäåéèêëíìîïóòôõöúùûüýÿçñ", "aaaaaaeeeeiiiiooooouuuuyycn"
    return F.trim(F.regexp_replace(F.translate(F.lower(name), *accents), r"[\s,;/()]+", " "))


def gazetteer(spark: SparkSession, regions: dict[str, dict[str, str]] = REGIONS) -> DataFrame:
    """(locale, name, region) of a table of regions; a leading code of two capitals is a name of its own."""
    rows = []
    for locale, own in regions.items():
        for region, places in own.items():
            for place in places.split(", "):
                code = place[:2] if len(place) > 3 and place[:2].isupper() and place[2] == " " else None
                rows += [(locale, n, region) for n in ([code, place[3:]] if code else [place])]
    return spark.createDataFrame(rows, "locale string, name string, region string").select("locale", place_name(F.col("name")).alias("name"), "region")


def regions(people: DataFrame, places: DataFrame, *, fields: Sequence[str], locale: str = "locale", out: str = "region_tag") -> DataFrame:
    """``people`` with the region of the place that a field names: the first field that names one, in it the longest name.

    ``places``: (locale, name, region), names as ``place_name`` gives them, each once a locale. A field names a place if it is
    that name or begins with its words; so the beginnings of a field, as many words long as names are, join the table by
    equality. Distinct fields are looked up once. Null where nothing is named.
    """
    longest = places.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    named = F.array(*[F.struct(F.lit(i).alias("i"), place_name(F.col(f).cast("string")).alias("t")) for i, f in enumerate(fields)])
    texts = people.select(F.col(locale).alias("_l"), F.explode(named).alias("f")).select("_l", F.col("f.t").alias("_t")).where("_t <> ''").distinct()
    begins = F.transform(F.sequence(F.lit(1), F.least(F.size(F.split("_t", " ")), F.lit(longest))), lambda n: F.array_join(F.slice(F.split("_t", " "), F.lit(1), n), " "))
    met = texts.withColumn("_b", F.explode(begins)).join(places.select(F.col("locale").alias("_pl"), F.col("name").alias("_b"), "region"), "_b").where("_l = _pl")
    best = met.groupBy("_l", "_t").agg(F.max_by("region", F.length("_b")).alias("_r"))
    rows = people
    for i, f in enumerate(fields):
        one = best.select(F.col("_l").alias(f"_l{i}"), F.col("_t").alias(f"_t{i}"), F.col("_r").alias(f"_r{i}"))
        rows = rows.join(one, (F.col(locale) == F.col(f"_l{i}")) & (place_name(F.col(f).cast("string")) == F.col(f"_t{i}")), "left").drop(f"_l{i}", f"_t{i}")
    found = [f"_r{i}" for i in range(len(fields))]
    return rows.withColumn(out, F.coalesce(*found)).drop(*found)
