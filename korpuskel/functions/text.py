"""Text functions as column expressions: tokens, normalisation, patterns, spreadsheet rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters and digits with marks, joined by . ' ’ or - where a letter or digit follows. Fixed value.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:[.'’-][\p{L}\p{N}][\p{L}\p{N}\p{M}]*)*"
#: Accented letters and what they fold to. Fixed values.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Patterns that give a passage its roles. Fixed values.
THRESHOLD = r"(?i)(?:[<>]=?|≤|≥)\s*\d|\b(?:at least|at most|less than|greater than|within)\s+\d|\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|copies/ml|cells/mm|days?|weeks?|months?|years?)\b"
EXCEPTION = r"(?i)\b(?:contraindicat\w*|ineligible|not eligible|unless|do not|should not|must not|not recommended|avoid(?:ed|ance)?|exclusion criter\w*)\b"
MONITORING = r"(?i)\b(?:monitor\w*|follow[- ]?up|viral load|test result|laborator\w*|indicator|numerator|denominator|screen(?:ing)?|surveillance)\b"
#: Words of evidence grades. Fixed values.
STRENGTH = r"(?i)\b(strong|conditional) recommendation\b"
CERTAINTY = r"(?i)\b(very low|low|moderate|high)[- ]certainty evidence\b"
#: Labels of populations and of care settings by pattern, and phrases of inclusion and exclusion. Fixed values.
POPULATIONS = {
    "people living with HIV": r"(?i)\bpeople living with hiv\b|\bpeople with hiv\b",
    "people with HIV-positive status": r"(?i)\bhiv-positive\b|\bhiv positive\b",
    "people with HIV-negative status": r"(?i)\bhiv-negative\b|\bhiv negative\b",
    "adolescents": r"(?i)\badolescents?\b",
    "children": r"(?i)\bchildren\b|\bchild\b",
    "infants": r"(?i)\binfants?\b",
    "adults": r"(?i)\badults?\b",
    "pregnant people": r"(?i)\bpregnan(?:t|cy)\b",
    "breastfeeding people": r"(?i)\bbreastfeed\w*\b",
    "transgender people": r"(?i)\btransgender\b",
    "sex workers": r"(?i)\bsex workers?\b",
    "people who inject drugs": r"(?i)\bpeople who inject drugs\b",
    "partners of people receiving HIV services": r"(?i)\bpartners?\b",
}
CARE_SETTINGS = {
    "primary health care": r"(?i)\bprimary health care\b",
    "antenatal care": r"(?i)\bantenatal care\b|\banc\b",
    "postnatal care": r"(?i)\bpostnatal\b|\bpostpartum\b",
    "community-based care": r"(?i)\bcommunit(?:y|ies)\b",
    "health facilities": r"(?i)\bfacilit(?:y|ies)\b",
    "laboratory and diagnostic services": r"(?i)\blaborator\w*\b|\bdiagnostic\w*\b",
    "HIV testing services": r"(?i)\bhiv testing services?\b|\bhts\b",
    "HIV prevention services": r"(?i)\bprep\b|\bpep\b",
    "tuberculosis services": r"(?i)\btb services?\b|\btuberculosis\b",
}
INCLUSION = r"(?i)\brequired if\s+(.{1,180}?)(?=(?:\s{2,}|\bnot classifiable\b|$))"
EXCLUSION = r"(?i)\b(?:contraindicated (?:for|in)|not eligible (?:for|if)?)\s+(.{1,140}?)(?=[.;]|$)"
#: Patterns of the topics of a passage. Fixed values.
TOPICS = {
    "negation": r"(?i)\b(?:not|no|never|without|avoid|contraindicat\w*|mustn['’]?t|shouldn['’]?t)\b",
    "dose": r"(?i)\b(?:\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|mmol|units?|copies|cells)|dose|dosage|threshold)\b",
    "monitoring": r"(?i)\b(?:monitor\w*|follow[- ]?up|screen\w*|test(?:ing)?|assess\w*|surveillance)\b",
    "applicability": r"(?i)\b(?:eligible|eligibility|population|adult|child|adolescen\w*|pregnan\w*|infant|criteria)\b",
    "terminology": r"\b(?:[A-Z][A-Z0-9+.-]{1,}|[A-Z]\d{2,}|\d{2,}[A-Z]\w*)\b",
}
#: Words too usual to pair passages by. Fixed values.
CONFLICT_STOPWORDS = "about after also before being between could from have into more other should than that their there these this those through under using were when where which with would".split()
#: Values of a spreadsheet that mean nothing is there. Fixed values.
PLACEHOLDERS, PLACEHOLDER_START = ["", "-", "--", "–", "n/a", "na", "none", "not applicable", "nil"], "not classifiable in"
#: Words too usual to point at, and the endings a term may differ by. Fixed values.
TERM_STOPWORDS = (
    "about after again all and any are been before being between both but can does doing done for from had has have her here him his how into its may might more most much must "
    "not now off once only other our out over own recommend recommended same she should some such than that the their them then there these they this those through under until "
    "use used very was what when where which while who why will with would you your"
).split()
ENDING = r"(?:ing|ed|es|s)$"
MOST_TERMS, SHORTEST_TERM, SHORTEST_STEM = 40, 3, 4
#: Explicit facts of a question. Fixed values.
AGE = r"(?i)\b(\d{1,3})\s*(?:-|\s)\s*year(?:s)?(?:-|\s)old\b"
MEASUREMENTS = {"EGFR": r"(?i)\begfr\s*(?:is|of|=|:)?\s*(\d+(?:\.\d+)?)\b", "CRCL": r"(?i)\b(?:crcl|creatinine clearance)\s*(?:is|of|=|:)?\s*(\d+(?:\.\d+)?)\b"}
CONDITIONS = {"ATRIAL_FIBRILLATION": r"(?i)\b(?:atrial fibrillation|afib|af)\b", "CHRONIC_KIDNEY_DISEASE": r"(?i)\b(?:chronic kidney disease|ckd)\b"}
#: Characters beyond ASCII with which the built-in tokens are exact: the accents above, and signs that are no letters or digits in any form.
PLAIN_SIGNS = "‘’“”–—…•≤≥×°±§©®«»¡¿\u00a0\u2009\u202f"
_NEEDS_EXACT = rf"[^\x00-\x7F{ACCENTED}{ACCENTED.upper().replace('Ÿ', '')}ßŸ{PLAIN_SIGNS}]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LONG_NUMBER = r"\b\d{6,}\b"
NUMERAL = r"\d+(?:\.\d+)?"


def fold_case(text: Column) -> Column:
    """Lower case, with ß as ss, as case folding has it."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """The words of a text in its order; empty for null."""
    return F.coalesce(F.regexp_extract_all(fold_case(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def unaccented(word: Column) -> Column:
    """A word with the accents of western languages taken off."""
    return F.translate(word, ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Words, each followed by its form without accents where that differs."""
    both = F.flatten(F.transform(words(text), lambda w: F.when(unaccented(w) != w, F.array(w, unaccented(w))).otherwise(F.array(w))))
    return F.when(fold_case(text).rlike(f"[{ACCENTED}]"), both).otherwise(words(text))


def needs_exact(text: Column) -> Column:
    """True for texts with characters for which the built-in tokens may be inexact; see ``functions.exact``."""
    return F.coalesce(text.rlike(_NEEDS_EXACT), F.lit(False))


#: A run of white space, with the blanks that aren't ASCII. Fixed value.
WHITE = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+"


def search_view(text: Column) -> Column:
    """One blank for each run of white space of any kind, none outside."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def presentation(text: Column) -> Column:
    """Line feeds only, single blanks, trimmed lines, at most one blank line in a row."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    spaced = F.regexp_replace(unix, r"[ \t]+", " ")
    lines = F.regexp_replace(spaced, r" *\n *", "\n")
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit(" \n"))


def narrative_print(text: Column) -> Column:
    """SHA-256 of the case-folded presentation of a text, ended by a unit separator."""
    return F.sha2(F.concat(fold_case(presentation(text)), F.lit("\x1f")), 256)


def short_id(prefix: str, *parts: Column) -> Column:
    """A deterministic id: prefix and 32 hex digits of the SHA-256 of the parts joined by |."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def term_index(term: Column, seed: str, dimension: int) -> Column:
    """Position of a term in a hashed sparse vector: the first four bytes of SHA-256, lowest first, modulo the dimension."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\0"), term), 256)
    swapped = F.concat(*[F.substring(digest, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("bigint") % F.lit(dimension)


def feature_hash(feature: Column, dimension: int) -> tuple[Column, Column]:
    """(position, sign) of a feature: eight bytes of SHA-256, lowest first, modulo the dimension; -1 where the ninth is odd."""
    digest = F.sha2(feature, 256)
    swapped = F.concat(*[F.substring(digest, i, 2) for i in range(15, 0, -2)])
    at = (F.conv(swapped, 16, 10).cast("decimal(20,0)") % F.lit(dimension)).cast("int")
    odd = F.conv(F.substring(digest, 18, 1), 16, 10).cast("int") % 2 == 1
    return at, F.when(odd, -1.0).otherwise(1.0)


def point_id(namespace: str, name: Column) -> Column:
    """A UUID of version 5 in a namespace (32 hex digits, dashes or not)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substring(F.lit("89ab"), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


#: A word of the baseline: letters, digits and underscores, joined by ' ’ or -. Fixed value.
BASELINE = r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*"


def baseline_words(text: Column) -> Column:
    """Words joined by apostrophes and hyphens in folded case; of a text without any, its characters but white space as one word; empty for null and blank texts."""
    folded = fold_case(text)
    found = F.regexp_extract_all(folded, F.lit(BASELINE), F.lit(0))
    squeezed = F.regexp_replace(folded, r"\s", "")
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.size(found) > 0, found).when(squeezed != "", F.array(squeezed)), none)


_LOOSE = r"[\p{L}\p{N}_+.-]+"


def loose_tokens(text: Column, shortest: int = 3) -> Column:
    """The set of tokens of a minimum length, in folded case, in order of appearance."""
    found = F.filter(F.regexp_extract_all(text, F.lit(_LOOSE), F.lit(0)), lambda t: F.length(t) >= shortest)
    return F.coalesce(F.array_distinct(F.transform(found, fold_case)), F.array().cast("array<string>"))


def conflict_tokens(text: Column) -> Column:
    """The set of tokens that passages may be paired by: four characters or more, no numbers, no usual words."""
    usual = F.array(*[F.lit(w) for w in CONFLICT_STOPWORDS])
    return F.filter(loose_tokens(text, 4), lambda t: ~t.rlike(r"^\p{Nd}+$") & ~F.array_contains(usual, t))


#: Words that are identifiers, not language; and bounds of a paraphrase: words replaced, words kept, tokens, terms in all, shared tokens. Fixed values.
IDENTIFIER_WORD = r"^(?:[A-Za-z]{1,6}\.[\w.]+|[A-Z]{2,}\d[\w.-]*|\d[\w.-]*|[\w-]*\d{3,}[\w-]*)$"
LEAST_REPLACED, LEAST_KEPT, LEAST_TOKENS, MOST_WORDS, MOST_OVERLAP = 3, 3, 8, 60, 0.55


def paraphrase(text: Column, vocabulary: dict[str, str], usual: list[str]) -> Column:
    """(``question``, ``overlap``): a text said in other words, or null where the bounds aren't met.

    Words shorter than three characters, usual ones and identifiers are left out,
    words of the vocabulary replaced, repeats in folded case dropped. ``overlap``
    is the share of the question's tokens that the text holds.
    """
    swaps = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    skip = F.array(*[F.lit(w) for w in usual]).cast("array<string>")
    words = F.filter(F.regexp_extract_all(text, F.lit(_LOOSE), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.array_contains(skip, fold_case(w)) & ~w.rlike(IDENTIFIER_WORD))
    replaced = F.size(F.filter(words, lambda w: F.map_contains_key(swaps, fold_case(w))))
    said = F.split(F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(swaps, fold_case(w)), w)), " "), " ")
    none = F.array().cast("array<string>")
    full = lambda acc, w: (F.size(acc["keys"]) >= MOST_WORDS) | F.array_contains(acc["keys"], fold_case(w))
    first = F.aggregate(said, F.struct(none.alias("keys"), none.alias("words")), lambda acc, w: F.when(full(acc, w), acc).otherwise(F.struct(F.array_append(acc["keys"], fold_case(w)).alias("keys"), F.array_append(acc["words"], w).alias("words"))))
    question = F.array_join(first["words"], " ")
    asked = loose_tokens(question)
    overlap = F.round(F.size(F.array_intersect(asked, loose_tokens(text))) / F.greatest(F.size(asked), F.lit(1)), 9)
    fits = (replaced >= LEAST_REPLACED) & (F.size(words) - replaced >= LEAST_KEPT) & (F.size(asked) >= LEAST_TOKENS) & (overlap <= MOST_OVERLAP)
    return F.when(fits, F.struct(question.alias("question"), overlap.alias("overlap")))


def fragment(text: Column, most: int) -> Column:
    """A text with single blanks, cut at ``most`` characters and there back to the last blank."""
    view = search_view(text)
    cut = F.substring(view, 1, most)
    back = F.regexp_replace(cut, r" [^ ]*$", "")
    return F.when(F.length(view) <= most, view).when(cut.contains(" ") & (back != ""), back).otherwise(cut)


def question_terms(*sources: Column) -> Column:
    """The words worth pointing at, as stems, in order: at most ``MOST_TERMS``.

    One usual ending is taken off where at least ``SHORTEST_STEM`` letters stay.
    """
    usual = F.array(*[F.lit(w) for w in TERM_STOPWORDS])
    raw = F.flatten(F.array(*[F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}-]+") for x in sources]))
    bare = F.transform(raw, lambda w: F.regexp_replace(w, r"^-+|-+$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) >= SHORTEST_TERM) & ~F.array_contains(usual, w))
    short = lambda w: F.regexp_replace(w, ENDING, "")
    stems = F.transform(kept, lambda w: F.when(F.length(short(w)) >= SHORTEST_STEM, short(w)).otherwise(w))
    return F.slice(F.array_distinct(stems), 1, MOST_TERMS)


def humanised(code: Column) -> Column:
    """A code as words: blanks for underscores, only the first letter large."""
    plain = F.lower(F.replace(code, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 30))


def is_placeholder(value: Column) -> Column:
    """A spreadsheet value that says nothing is there; null counts as such."""
    plain = F.lower(F.trim(value, F.lit(" \t\n\r")))
    return F.coalesce(plain.isin(PLACEHOLDERS) | plain.startswith(PLACEHOLDER_START), F.lit(True))


def json_depth(text: Column) -> Column:
    """How deep the brackets of a JSON text nest; strings don't count."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    steps = F.transform(F.filter(F.split(marks, ""), lambda c: c != ""), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda acc, d: F.struct((acc["now"] + d).alias("now"), F.greatest(acc["most"], acc["now"] + d).alias("most")))
    return F.when(text.isNotNull(), walk["most"])


def version_parts(version: Column) -> Column:
    """(major, minor, patch) of an exact version like 1.2.3; null for others, also for pre-releases."""
    parts = F.split(version, r"\.")
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.struct(*[parts[i].try_cast("bigint").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def column_ordinal(letters: Column) -> Column:
    """1 for A, 27 for AA, and so on."""
    return F.aggregate(F.transform(F.split(letters, ""), lambda c: F.ascii(c) - 64), F.lit(0), lambda acc, v: acc * 26 + v)


def column_letters(ordinal: Column) -> Column:
    """A for 1, AA for 27, up to ZZZ; null for a number below 1."""
    one = lambda n: F.chr((65 + n % 26).cast("int"))
    first, second, third = ordinal - 1, F.floor((ordinal - 1) / 26) - 1, F.floor((F.floor((ordinal - 1) / 26) - 1) / 26) - 1
    letters = F.concat(F.when(third >= 0, one(third)).otherwise(""), F.when(second >= 0, one(second)).otherwise(""), one(first))
    return F.when(ordinal >= 1, letters)


def cell_label(sheet: Column, row_index: Column, column_index: Column) -> Column:
    """Sheet!C4 from indices that count from 0; null if any is missing."""
    return F.concat(sheet, F.lit("!"), column_letters(column_index + 1), (row_index + 1).cast("string"))


def cells(text: Column) -> Column:
    """Cells of a spreadsheet row written as lines COL+ROW=value, in their order; other lines continue the cell before.

    A line that looks like a cell of another row, or of the same or an earlier
    column, is such a continuation. Null for a text that doesn't begin with a cell.
    """
    cell = r"(?s)^([A-Z]{1,3})([0-9]+)=(.*)$"
    parsed = F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(
            F.regexp_extract(line, cell, 1).alias("column"), F.regexp_extract(line, cell, 2).alias("row"), F.regexp_extract(line, cell, 3).alias("value"), line.alias("line")
        ),
    )
    kind = "array<struct<column:string,row:string,value:string>>"

    def step(acc: Column, item: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        starts = (item["column"] != "") & ((F.size(acc) == 0) | ((item["row"] == last["row"]) & (column_ordinal(item["column"]) > column_ordinal(last["column"]))))
        fresh = F.struct(item["column"].alias("column"), item["row"].alias("row"), item["value"].alias("value"))
        longer = F.struct(last["column"].alias("column"), last["row"].alias("row"), F.concat(last["value"], F.lit("\n"), item["line"]).alias("value"))
        return F.when(starts, F.array_append(acc, fresh)).when(F.size(acc) == 0, acc).otherwise(F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer))

    return F.when(text.rlike(r"^[A-Z]{1,3}[0-9]+="), F.aggregate(parsed, F.array().cast(kind), step))


def row_print(cells: Column, structural: list[str] = ()) -> Column:
    """SHA-256 over the cells of a spreadsheet row in folded case, addresses and structural columns left out: equal rows at any place."""
    kept = F.filter(cells, lambda c: ~c["column"].isin(list(structural))) if structural else cells
    parts = F.transform(kept, lambda c: F.concat(c["column"], F.lit("="), fold_case(presentation(c["value"])), F.lit("\x1f")))
    return F.sha2(F.array_join(parts, ""), 256)


def only_one(text: Column, pattern: str) -> Column:
    """What a pattern's group finds in lower case, if it finds just one thing."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def labels(text: Column, patterns: dict[str, str]) -> Column:
    """The labels whose pattern occurs, in order."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()])))


def grade(text: Column) -> Column:
    """(strength, certainty) of an evidence grade; null if either is given in more than one way, or neither at all."""
    found = {n: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lower)) for n, p in (("strength", STRENGTH), ("certainty", CERTAINTY))}
    sizes = [F.size(f) for f in found.values()]
    return F.when((sizes[0] <= 1) & (sizes[1] <= 1) & (sizes[0] + sizes[1] > 0), F.struct(*[F.get(f, F.lit(0)).alias(n) for n, f in found.items()]))


def scope(text: Column) -> Column:
    """Populations, care settings, inclusion and exclusion phrases that a text names, each in order."""
    view = F.coalesce(search_view(text), F.lit(""))
    required = F.transform(F.regexp_extract_all(view, F.lit(INCLUSION), F.lit(1)), lambda x: F.concat(F.lit("Required if "), F.trim(x)))
    excluded = F.transform(F.regexp_extract_all(view, F.lit(EXCLUSION), F.lit(0)), F.trim)
    phrases = {"inclusion_criteria": required, "exclusion_criteria": excluded}
    return F.struct(labels(view, POPULATIONS).alias("population"), labels(view, CARE_SETTINGS).alias("care_settings"), *[F.array_sort(F.array_distinct(p)).alias(n) for n, p in phrases.items()])


def stated_facts(question: Column) -> Column:
    """What a question says outright (age, conditions, measurements, topic), what follows from it, and which fields were worked out."""
    number = lambda p, kind: F.when(question.rlike(p), F.regexp_extract(question, p, 1).try_cast(kind))
    conditions = labels(question, CONDITIONS)
    measured = {name: number(p, "double") for name, p in MEASUREMENTS.items()}
    renal = F.coalesce(*measured.values()).isNotNull() | F.array_contains(conditions, "CHRONIC_KIDNEY_DISEASE")
    topic = F.when(F.lower(question).contains("anticoag"), F.lit("anticoagulation"))
    inferred = F.array_compact(F.array(F.when(renal, F.lit("special_populations")), F.when(topic.isNotNull(), F.lit("topic")), F.lit("question_type")))
    return F.struct(
        number(AGE, "int").alias("age"),
        conditions.alias("conditions"),
        *[m.alias(n.lower()) for n, m in measured.items()],
        renal.alias("renal_impairment"),
        topic.alias("topic"),
        F.when(topic.isNotNull(), "treatment_guideline").otherwise("guideline_lookup").alias("question_type"),
        inferred.alias("inferred"),
    )
