"""Language identification in two layers, and the dialect of Portuguese text. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent function words of each language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for", "it", "with", "as", "was", "on", "are", "this", "be", "by", "from", "or", "which", "you", "were", "an", "at", "not", "he", "his", "have", "has"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "sur", "par", "avec", "pas", "au", "aux", "est", "ce", "ne", "se", "sont", "plus", "ou", "nous", "vous"],
    "de": ["der", "die", "das", "und", "den", "dem", "des", "ein", "eine", "ist", "nicht", "mit", "von", "zu", "für", "auf", "im", "sich", "als", "auch", "es", "an", "werden", "aus", "bei", "wird", "sind", "oder"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "que", "en", "un", "una", "por", "con", "no", "para", "se", "es", "su", "al", "lo", "como", "más", "pero", "sus", "este", "son", "fue"],
    "pt": ["o", "a", "os", "as", "de", "do", "da", "dos", "das", "e", "que", "em", "um", "uma", "para", "com", "não", "por", "mais", "como", "mas", "foi", "ao", "ele", "tem", "seu", "sua", "ou", "ser", "são"],
}
# Letters and letter groups that tell the languages apart.
LETTERS = {"en": "th|wh|sh|ing", "fr": "eau|aux|[çêèœ]|oi", "de": "sch|ung|[äöüß]|ei", "es": "ción|[ñíú¿¡]|ll|os", "pt": "ção|[ãõ]|nh|lh"}
HEAD = 1_000
MIN_SCORE, MIN_CHARS = 0.65, 25


def _best(scores: dict[str, Column]) -> tuple[Column, Column]:
    """The language of the greatest score, ties by name; its share of all scores. Nothing scored: und, 0."""
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i")) for i, s in enumerate(scores.values())]))
    total = sum(scores.values(), F.lit(0))
    name = F.get(F.array(*[F.lit(k) for k in scores]), -best["i"])
    return F.when(total > 0, name).otherwise("und"), F.when(total > 0, best["s"] / total).otherwise(0.0)


def detect_words(text: Column) -> tuple[Column, Column]:
    """O-L1: language and score of the first 1,000 characters by their function words."""
    words = F.split(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, HEAD)), r"[^\p{L}]+")

    def score(listed: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(listed)))

    return _best({k: score(v) for k, v in STOP_WORDS.items()})


def detect_letters(text: Column) -> tuple[Column, Column]:
    """O-L2: an independent second opinion, by letters."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, HEAD))
    return _best({k: F.regexp_count(head, F.lit(v)) for k, v in LETTERS.items()})


def decide(first: Column, score: Column, second: Column, chars: Column, declared: Column, kept: list[str]) -> Column:
    """O-L3: the first layer's language, null where doubt calls the second and it disagrees, or where it isn't kept."""
    doubt = (score < MIN_SCORE) | (chars < MIN_CHARS) | (declared.isin(kept) & (first != declared))
    return F.when(first.isin(kept) & (~doubt | (first == second)), first)


# Families of cues, Brazilian and European, with weight and cap of each side.
DIALECT = [
    ([r"\b(?:estou|está|estamos|estão|estava|estavam|tô|to)\s+\w+[aei]ndo\b"], [r"\b(?:estou|estás|está|estamos|estão)\s+a\s+(?!partir\s+de\b)(?:\w{2,}(?:ar|er|ir)|ler|ver|vir|rir|pôr|ser|ter|dar|ir)\b"], 1.5, 3.0, 1.5, 3.0),
    (
        [r"\bvocês?\b"],
        [r"\b(?:fazes|queres|podes|sabes|tens|és|vais|estás|achas|dizes|gostas|precisas|consegues|deves|ficas|falas|pensas|escreves|lês|vês|dás|pões|vives|sentes|entendes|conheces|ajudas|usas|trabalhas|moras|percebes)\b"],
        0.5, 1.0, 2.0, 4.0,
    ),
    ([], [r"(?<![\w-])\w{2,}(?:ar|er|ir|e|a|ou|ei)-(?:me|te|se|lhe|lhes|nos|vos|o|a|os|as|lho|lha)\b(?!-)"], 1.5, 3.0, 1.5, 3.0),
    ([r"\b(?:pra|pras|pro|pros|tá|tô|né|cadê|valeu|beleza)\b", r"\ba gente\b"], [r"\b(?:fixe|bué|malta)\b", r"\bmiúd[oa]s?\b", r"\bestás a ver\b", r",\s*pá\b", r"\bpá\s*[!.?…]"], 1.0, 2.0, 1.0, 2.0),
    (
        [
            r"\bônibus\b", r"\btrem\b", r"\bcelular(?:es)?\b", r"\bbanheiros?\b", r"\bgeladeiras?\b", r"\bsorvetes?\b", r"\bcafé da manhã\b", r"\busuári[oa]s?\b", r"\barquivos?\b", r"\bsenhas?\b", r"\bsucos?\b",
            r"\b(?:o|os|um|uns|meu|meus|seu|seus|nosso|nossos|do|dos|no|nos|esse|este|aquele)\s+times?\b", r"\bequipes?\b", r"\btelas?\b", r"\besportes?\b", r"\bxícaras?\b", r"\baçougues?\b", r"\bcaminh(?:ão|ões)\b",
            r"\bfaixa de pedestres\b", r"\bternos?\b",
        ],
        [
            r"\bautocarros?\b", r"\bcomboios?\b", r"\btelemó(?:vel|veis)\b", r"\bcasa de banho\b", r"\bfrigoríficos?\b", r"\b(?:um|uns|dois|o|os|meu|meus|seu|seus)\s+gelados?\b", r"\bpequeno-almoços?\b", r"\butilizador(?:es|a|as)?\b",
            r"\bficheiros?\b", r"\bpalavras?-passe\b", r"\bsumos?\b", r"\bequipas?\b", r"\becrãs?\b", r"\bdesportos?\b", r"\bchávenas?\b", r"\btalhos?\b", r"\bcami(?:ão|ões)\b", r"\bpassadeiras?\b", r"\brelva\b",
        ],
        2.0, 6.0, 2.0, 6.0,
    ),
    (
        [r"\bgêner\w*", r"\beconôm\w*", r"\bfenômen\w*", r"\bbônus\b", r"\bantôni\w*", r"\banônim\w*", r"\bgême\w*", r"\bcômod\w*", r"\btênis\b", r"\bregistr\w*", r"\bcontatos?\b", r"\bcontatar\w*", r"\bde fato\b", r"\brecep\w*", r"\baspectos?\b"],
        [
            r"\bgéner\w*", r"\beconóm\w*", r"\bfenómen\w*", r"\bbónus\b", r"\bantóni\w*", r"\banónim\w*", r"\bgéme\w*", r"\bcómod\w*", r"\bténis\b", r"\bregist(?!r)\w+", r"\bcontactos?\b", r"\bcontactar\w*", r"\bde facto\b",
            r"\bfactos?\b", r"\brece(?:ção|cionista)\w*", r"\baspetos?\b",
        ],
        2.0, 6.0, 2.0, 6.0,
    ),
]
# What a country adds, by its key: Brazil, Portugal, Portuguese-speaking Africa and Timor.
BRAZIL = ["BR", "BRA", "BRAZIL", "BRASIL"]
PORTUGAL = ["PT", "PRT", "PORTUGAL"]
OTHERS = ["AO", "AGO", "ANGOLA", "MZ", "MOZ", "MOZAMBIQUE", "MOCAMBIQUE", "CV", "CPV", "CABO VERDE", "CAPE VERDE", "GW", "GNB", "GUINEA-BISSAU", "GUINE-BISSAU", "ST", "STP", "SAO TOME AND PRINCIPE", "TL", "TLS", "TIMOR-LESTE", "EAST TIMOR"]
MIN_TOTAL, MIN_MARGIN = 2.0, 0.25


def required_literal(pattern: str) -> str:
    """The longest run of plain letters that every match of a pattern must hold; empty where none is certain.

    Only what stands outside of groups and classes counts; a letter that may be absent ends a run before it.
    """
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, step = pattern[i], 1
        plain = c.isalnum() or c in " -,"
        if depth == 0 and plain:
            run += c
        else:
            if c in "?*{":  # the unit before may be absent
                run = run[:-1]
            runs, run = [*runs, run], ""
            if c == "\\":
                step = 2
            elif c == "[":
                step = pattern.index("]", i) - i + 1
            elif c == "{":
                step = pattern.index("}", i) - i + 1
            elif c in "()":
                depth += 1 if c == "(" else -1
            elif c == "|" and depth == 0:
                return ""
        i += step
    return max([*runs, run], key=len)


def _guarded_count(low: Column, pattern: str) -> Column:
    """Matches of a pattern; a text without the letters that any match needs is not searched by the regex."""
    found = F.regexp_count(low, F.lit("(?U)" + pattern))
    need = required_literal(pattern)
    return F.when(F.contains(low, F.lit(need)), found).otherwise(0) if need else found


def dialect_scores(text: Column, country: Column) -> tuple[Column, Column]:
    """O-L5, O-L6: the Brazilian and European totals of a text and its author's country."""
    from quarry.functions.text import country_key

    low = F.lower(F.coalesce(text, F.lit("")))
    key = country_key(country)
    br, pt = F.when(key.isin(BRAZIL), 2.0).otherwise(0.0), F.when(key.isin(PORTUGAL), 2.0).when(key.isin(OTHERS), 1.0).otherwise(0.0)
    for brazilian, european, w_br, cap_br, w_pt, cap_pt in DIALECT:
        count = lambda patterns: sum((_guarded_count(low, p) for p in patterns), F.lit(0))
        br, pt = br + F.least(count(brazilian) * w_br, F.lit(cap_br)), pt + F.least(count(european) * w_pt, F.lit(cap_pt))
    return br, pt


def dialect(br: Column, pt: Column) -> tuple[Column, Column]:
    """O-L7: pt-BR, pt-PT or pt-indef, and the relative margin in four places."""
    most, least = F.greatest(br, pt), F.least(br, pt)
    weak = (br == pt) | (most < MIN_TOTAL)
    margin = F.when(weak, 0.0).otherwise(F.round((most - least) / F.when(most + least > 0, most + least), 4))
    return F.when(weak | (margin < MIN_MARGIN), "pt-indef").when(br > pt, "pt-BR").otherwise("pt-PT"), margin
