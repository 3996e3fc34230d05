"""Text functions as column expressions: folding, tokens, scripts, languages, questions, noise, transliteration."""

from __future__ import annotations

import itertools
import re
import unicodedata

from pyspark.sql import Column, functions as F

# Word lists that results depend on.
GREEKLISH_MARKERS = """
    kai ki einai ine itan pws pos pou poy poio poia poios poso posa posoi pote giati gt gia ya
    na tha den dn de mou moy sou soy mas sas tous tis twn ton tin thn tha me se apo ap sto sth
    stin stis ston sta afto auto ayto afta auta ayta auth aftos kati kapoios kanei kanw kano
    exei exw exo exeis eimai eisai mporw mporo mporei prepei thelw thelo kserei kserw ksero
    nai oxi ohi ola olo oloi kala kalo kalh kali polu poli ligo pio mono akoma akomh twra tora
    meta prin otan opou opws dld dhladh dhl re reee leme pame vazw bazw vriskw brisko vrisko
""".split()
GREEK_STOPWORDS = """
    και κι είναι ήταν πως πώς που πού ποιο ποια ποιος πόσο πόσα πότε γιατί για να θα δεν μη μην
    μου σου μας σας τους τις των τον την το τα η ο οι με σε από στο στη στην στις στον στα
    αυτό αυτά αυτή αυτός κάτι κάνει έχει έχω είμαι μπορώ πρέπει θέλω ναι όχι όλα πολύ πιο
    μόνο ακόμα τώρα μετά πριν όταν όπου όπως δηλαδή ένα μια ένας
""".split()
ENGLISH_STOPWORDS = """
    a an the is are was were be been am do does did to of in on at for from by with and or not
    no yes it its this that these those what which who whom whose where when why how can could
    should would will shall may might must i you he she we they me him her us them my your our
    their there here any some all much many more most very just also than then so if about into
    get got has have had please tell know does anyone someone pls plz
""".split()
INTERROGATIVES = """
    what where when why how who which whose whom can could does do did is are was were will would should
    τι πού που πώς πως πότε ποτε γιατί γιατι ποιος ποια ποιο ποιοι ποιες πόσο ποσο πόσα ποσα πόσες ποιον μπορώ
    μπορω υπάρχει υπαρχει ξέρει ξερει ξέρετε ξερετε
    ti pou poy pws pos pote giati gt poios poia poio poioi posa poso posoi mporw mporo yparxei uparxei kserei
    kserete
""".split()
TEACH_PREFIXES = ("learn:", "μάθε:", "μαθε:", "mathe:", "note:", "σημείωσε:", "shmeiwse:")
GREEK_LETTERS = {"α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "ks", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "x", "ψ": "ps", "ω": "w"}
GREEK_PAIRS = {"ου": "ou", "αι": "ai", "ει": "ei", "οι": "oi", "μπ": "mp", "ντ": "nt", "γκ": "gk"}
GREEK_SPELLINGS = {"η": ("i", "h"), "θ": ("th", "8"), "υ": ("y", "i", "u"), "χ": ("x", "h", "ch"), "ω": ("w", "o"), "ξ": ("ks", "x"), "ψ": ("ps",), "β": ("v", "b"), "ου": ("ou", "u"), "ει": ("ei", "i"), "οι": ("oi", "i"), "αι": ("ai", "e"), "μπ": ("mp", "b"), "ντ": ("nt", "d"), "γκ": ("gk", "g"), "φ": ("f", "ph")}
# Patterns that results depend on.
URL = r"https?://\S+"
MENTION = r"<[@#][!&]?\d+>|<a?:\w+:\d+>"
UNIT = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:%|h|hr|hrs|m|min|mins|s|sec|k|kk|x|lvl|level|ώρες|λεπτά|lepta|wres)\b"
NUMBER = r"\d+(?:[.,]\d+)?"
LINK = r"https?://|www\.|<[@#&!]|@everyone|@here|\]\("
TOKEN = r"[\p{L}\p{N}]+(?:[.'’][\p{L}\p{N}]+)*"


def fold_text(text: str) -> str:
    """What fold() computes, for one string: no accents, casefolded."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return bare.casefold()


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin and Greek blocks that fold to one other letter, and those letters."""
    source, target = [], []
    for code in itertools.chain(range(0x00AA, 0x0250), range(0x0370, 0x0400), range(0x1E00, 0x2000)):
        c = chr(code)
        folded = fold_text(c)
        if len(folded) == 1 and folded != c and folded.isalnum():
            source.append(c)
            target.append(folded)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def fold(c: Column) -> Column:
    """Lower case without accents, in native expressions: exact for Latin and Greek letters."""
    bare = F.regexp_replace(F.translate(F.lower(F.replace(c, F.lit("ß"), F.lit("ss"))), ACCENTED + "ς", PLAIN + "σ"), r"\p{M}", "")
    return bare


def tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0)), lambda t: F.replace(t, F.lit("’"), F.lit("'")))


def normalize(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def _one_of(c: Column, words: list[str]) -> Column:
    """Whether c is one of the folded words; a list of constants becomes a hash set."""
    return c.isin(sorted({fold_text(w) for w in words}))


def is_content(token: Column) -> Column:
    """Whether a token is no stop word; single characters only if they are digits."""
    return ~_one_of(token, ENGLISH_STOPWORDS + GREEK_STOPWORDS + GREEKLISH_MARKERS) & ((F.length(token) > 1) | token.rlike(r"^\d+$"))


def content_tokens(c: Column) -> Column:
    """Tokens without stop words; single characters only if they are digits."""
    return F.filter(tokens(c), is_content)


def numbers(c: Column) -> Column:
    """Distinct numbers with a decimal point."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("."))))


def has_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def script(c: Column) -> Column:
    greek, latin = F.regexp_count(c, F.lit("[Ͱ-Ͽἀ-῿]")), F.regexp_count(c, F.lit("[a-zA-Z]"))
    return F.when((greek == 0) & (latin == 0), "other").when(greek >= latin, "greek").otherwise("latin")


def language_style(c: Column) -> Column:
    """en, el or greeklish."""
    t = tokens(c)
    hits, english = (F.size(F.filter(t, lambda x: _one_of(x, w))) for w in (GREEKLISH_MARKERS, ENGLISH_STOPWORDS))  # noqa: B023
    greeklish = ((hits >= 2) & (hits > english)) | ((hits >= 1) & (F.size(t) <= 4) & (english == 0))
    return F.when(script(c) == "greek", "el").when(greeklish, "greeklish").otherwise("en")


def supported_language(c: Column) -> Column:
    """el by script, en by the share of stop words among the tokens of the first 5000 characters, else null."""
    head = tokens(F.substring(c, 1, 5000))
    share = F.size(F.filter(head, lambda x: _one_of(x, ENGLISH_STOPWORDS))) / F.greatest(F.size(head), F.lit(1))
    s = script(c)
    return F.when(s == "greek", "el").when((s == "latin") & (share >= 0.12), "en")


def is_question(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(t.rlike(r"[?;;]$") | _one_of(F.get(tokens(t), F.lit(0)), INTERROGATIVES), F.lit(False))


def teach_prefix(c: Column) -> Column:
    """What follows a teaching prefix, or null."""
    pattern = "(?isu)^(?:" + "|".join(map(re.escape, TEACH_PREFIXES)) + r")\s*(.*)$"
    return F.when(F.trim(c).rlike(pattern), F.trim(F.regexp_extract(F.trim(c), pattern, 1)))


def strip_noise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, URL, " "), MENTION, " "))


def has_unit(c: Column) -> Column:
    return c.rlike(UNIT)


def strip_mentions(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"<@!?\d+>", ""))


def safe_markdown(c: Column) -> Column:
    """Links with their target shown; mass mentions broken by a zero-width space."""
    return F.regexp_replace(F.regexp_replace(c, r"\[([^\]]*)\]\((https?://[^)\s]+)\)", "$1 (<$2>)"), "@(everyone|here)", "@​$1")


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def claim_number(c: Column) -> Column:
    """The number of a reference such as K-12."""
    return F.nullif(F.regexp_extract(F.trim(c), r"^(?:[Kk]-?)?(\d+)$", 1), F.lit("")).cast("long")


def first_version(c: Column, patterns: list[str]) -> Column:
    """The first pattern that matches gives its first group, or its whole match."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1 if re.compile(p).groups else 0), F.lit("")) for p in patterns])


def url_key(c: Column) -> Column:
    """Scheme, lower-case host without port, path without final slash, query; no fragment."""
    host, path, query = (F.parse_url(c, F.lit(p)) for p in ("HOST", "PATH", "QUERY"))
    return F.concat(F.lower(F.parse_url(c, F.lit("PROTOCOL"))), F.lit("://"), F.lower(host), F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))


#: Second-level labels under which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "govt", "ltd", "me", "mil", "ne", "net", "nhs", "or", "org", "plc", "sch")


def registrable_domain(c: Column) -> Column:
    """The last two labels of the host, or three where a country registers names below such a label (no public-suffix list is at hand)."""
    host = F.lower(F.parse_url(c, F.lit("HOST")))
    third = F.regexp_extract(host, r"([^.]+\.(?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2})$", 1)
    return F.when(third != "", third).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))


def greeklish(c: Column) -> Column:
    """Greek words in Latin letters, the first letter's case kept."""

    def word(w: Column) -> Column:
        low = fold(w)
        for pair, latin in GREEK_PAIRS.items():
            low = F.replace(low, F.lit(pair), F.lit(latin))
        for letter, latin in GREEK_LETTERS.items():
            if len(latin) > 1:
                low = F.replace(low, F.lit(letter), F.lit(latin))
        single = {k: v for k, v in GREEK_LETTERS.items() if len(v) == 1}
        low = F.translate(low, "".join(single), "".join(single.values()))
        raised = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 20))
        head = F.substring(w, 1, 1)
        return F.when(~w.rlike("[Ͱ-Ͽἀ-῿]"), w).when(F.upper(head) == head, F.when(F.lower(head) != head, raised).otherwise(low)).otherwise(low)

    parts = F.split(c, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    return F.array_join(F.transform(parts, word), "")


def spellings(alias: str, limit: int = 24) -> list[str]:
    """Spellings of a short Greek alias in Latin letters, no more than limit of them."""
    folded = " ".join(re.findall(r"[^\W_]+(?:[.'’][^\W_]+)*", fold_text(alias)))
    if not re.search("[Ͱ-Ͽἀ-῿]", folded):
        return []
    words = []
    for word in folded.split(" "):
        units = re.findall("|".join(GREEK_PAIRS) + "|.", word)
        choices = [GREEK_SPELLINGS[u] if u in GREEK_SPELLINGS else [GREEK_PAIRS.get(u) or GREEK_LETTERS.get(u, u)] for u in units]
        words.append(["".join(p) for p in itertools.islice(itertools.product(*choices), limit)])
    return sorted({" ".join(p) for p in itertools.islice(itertools.product(*words), limit)})


def token_match(q: Column, d: Column) -> Column:
    """Equal, or one a prefix of the other (both of 4 letters at least), or the same first 5 letters."""
    long4 = (F.length(q) >= 4) & (F.length(d) >= 4) & (F.startswith(d, q) | F.startswith(q, d))
    return (q == d) | long4 | ((F.length(q) >= 5) & (F.length(d) >= 5) & (F.substring(q, 1, 5) == F.substring(d, 1, 5)))


def coverage(query: Column, doc: Column, satisfied: Column | None = None) -> Column:
    """The share of query tokens that a document token matches or that are satisfied anyway; 0 without tokens."""
    hit = lambda q: F.exists(doc, lambda t: token_match(q, t))
    full = hit if satisfied is None else (lambda q: F.array_contains(satisfied, q) | hit(q))
    return F.when(F.size(query) > 0, F.size(F.filter(query, full)) / F.size(query)).otherwise(F.lit(0.0))
