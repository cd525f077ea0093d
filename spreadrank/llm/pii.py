"""PII: detected entities get keyed surrogates of the same type and format, with DataFrame functions only.

Entities: e-mail and IPv4 addresses, phone and card numbers, access keys and passwords, long hexadecimal secrets, and names
after a title. What is found has its title or keyword with it (``Mrs Smith``, ``password=...``), which stays and gives the type and
the gender. A surrogate is drawn from SHA-256 of (key, type, gender, value, attempt):

* digits become digits, letters become letters of the same case and script (Latin, Greek or Cyrillic), other marks stay; hexadecimal stays
  hexadecimal; cards keep their first digit and get a valid check digit; addresses move to reserved domains, to 10.0.0.0/8 and, when
  drawn again, to 240.0.0.0/4;
* names are built from syllables of the value's script, with an ending of the title's gender; each redraw has a syllable more.

Coreference: equal values (e-mail addresses and hexadecimal without regard to case) of a type and gender get one surrogate in all
documents. In a document with names, other capitalised words equal to a word of one of them become that word's surrogate (of two
names with the word, the first by order of their text). Distinctness:
surrogates that two values share, or that are themselves a value of the corpus, are drawn anew (all but the least value's)
until none is left. Mentions are joined to the values on their hash (Spark can split a hot one), and a document's
mentions are put back in one pass over the pieces between them, so no surrogate is ever replaced itself.

n_entities counts what the patterns find, not the later words of a name. Null texts stay null; texts without entities are
unchanged. Repeated rows and null ids as in ``common``; columns n_entities and entity_types of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.common import bound, drop_tables, materialize, one_row_per_doc

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
#: A word of a name; a possessive ending isn't part of it.
WORD = r"\p{Lu}(?:\p{L}|['-](?!s\b)(?=\p{L}))+"
KEYWORD = "password|passwd|pwd|secret|token|api_key"
#: type and pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "password": rf"\b(?:{KEYWORD})[=:][^\s\"',;]{{6,}}",
    "hex": r"\b(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<!\d)[3-6]\d{12,18}(?!\d)",
    "name": rf"\b(?:{MALE}|{FEMALE})\.? {WORD}(?: {WORD})?",
}
#: What stays of a find: its title or keyword.
PREFIX = rf"^(?:(?:{KEYWORD})[=:]|(?:{MALE}|{FEMALE})\.? (?=\p{{Lu}}))"
LATER = rf"(?<!\p{{L}}){WORD}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: only such texts are searched in full.
HINT = rf"[0-9@]|password|passwd|pwd|secret|token|api_key|\b(?:{MALE}|{FEMALE})\.? \p{{Lu}}"
LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "ri", "sa", "te", "vi", "lo", "ru", "ne"],
    "greek": ["βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πα", "ρι", "σα", "τε", "χι", "λο", "ρου", "νε"],
    "cyrillic": ["ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ри", "са", "те", "ви", "ло", "ру", "не"],
}
ENDING = {"latin": ("nor", "nia"), "greek": ("νος", "νια"), "cyrillic": ("нор", "ния")}


def kind(raw: Column) -> Column:
    """The type of a find: by its keyword or title, else by the pattern that it has."""
    out = F.when(raw.rlike(rf"^(?:{KEYWORD})[=:]"), "password").when(raw.rlike(rf"^(?:{MALE}|{FEMALE})\.? \p{{Lu}}"), "name").when(raw.contains("@"), "email")
    for name in ("access_key", "hex", "ip", "phone", "ssn"):
        out = out.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), name)
    return out.otherwise("card")


def mentions(text: Column) -> Column:
    """The entities of a text in order, as an array of strings."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _digest(*parts: Column) -> Column:
    """128 hexadecimal digits."""
    text = F.concat_ws("\x1f", *parts)
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(F.lit("+"), text), 256))


def _number(digest: Column, i: Column) -> Column:
    """16 bits of the digest for place i; places beyond its length get others."""
    at = F.pmod(i * 4, F.lit(124)) + 1
    bits = F.conv(F.substr(digest, at, F.lit(4)), 16, 10).cast("int")
    return F.pmod(bits + F.floor(i / 31).cast("int") * 7919, F.lit(65536))


def _like(value: Column, digest: Column, hexadecimal: Column) -> Column:
    """A value of the same format: digits for digits, letters for letters of the same case and script."""

    def one(c: Column, i: Column) -> Column:
        r = _number(digest, i)
        pick = lambda letters: F.substr(F.lit(letters), F.pmod(r, F.lit(len(letters))) + 1, F.lit(1))
        out = F.when(c.rlike(r"^\d$"), pick("0123456789")).when(hexadecimal & c.rlike("^[a-f]$"), pick("abcdef")).when(hexadecimal & c.rlike("^[A-F]$"), pick("ABCDEF"))
        for script, letters in LOWER.items():
            own = {"latin": "IsLatin", "greek": "IsGreek", "cyrillic": "IsCyrillic"}[script]
            out = out.when(c.rlike(rf"^[\p{{{own}}}&&\p{{Lu}}]$"), pick(letters.upper())).when(c.rlike(rf"^[\p{{{own}}}&&\p{{Ll}}]$"), pick(letters))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, "", -1), one), "")


def _card(value: Column) -> Column:
    """The value with its first digit as before and its last set for a valid Luhn sum."""

    def checked(v: Column) -> Column:
        digits = F.reverse(F.split(F.regexp_replace(v, r"\D", ""), ""))
        total = F.aggregate(F.transform(digits, lambda d, i: F.when(i == 0, 0).when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))), F.lit(0), lambda a, x: a + x)
        return F.concat(F.substr(v, F.lit(1), F.length(v) - 1), F.pmod(-total, F.lit(10)).cast("string"))

    return bound(value, checked)


def _name(value: Column, female: Column, digest: Column, attempt: Column) -> Column:
    """As many words as the value has, of syllables of its script; the given name ends as the title's gender asks.

    Each attempt adds a syllable to the given name, so that there are 16 times as many names to draw from.
    """
    script = F.when(value.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    out = F.lit(None).cast("string")
    for s, parts in SYLLABLES.items():
        table = F.array(*map(F.lit, parts))
        syllable = lambda i, table=table: F.get(table, F.pmod(_number(digest, i), F.lit(16)))
        more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(7), attempt + 6), lambda i: syllable(i)), "")).otherwise("")
        given = F.initcap(F.concat(*[syllable(F.lit(i)) for i in range(3)], more, F.when(female, ENDING[s][1]).otherwise(ENDING[s][0])))
        family = F.initcap(F.concat(*[syllable(F.lit(i)) for i in range(3, 7)]))
        out = F.when(script == s, F.when(F.instr(value, " ") > 0, F.concat(given, F.lit(" "), family)).otherwise(given)).otherwise(out)
    return out


def surrogate(type_: Column, value: Column, female: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a value at the given attempt."""

    def of(d: Column) -> Column:
        byte = lambda i: F.pmod(_number(d, F.lit(i)), F.lit(254)).cast("string")
        local = F.substring_index(value, "@", 1)
        word = F.array_join(F.transform(F.sequence(F.lit(20), F.lit(27)), lambda i: F.substr(F.lit(LOWER["latin"]), F.pmod(_number(d, i), F.lit(26)) + 1, F.lit(1))), "")
        like = _like(value, d, type_.isin("hex") | (type_ == "password") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
        return (
            F.when(type_ == "email", F.concat(_like(local, d, F.lit(False)), F.lit("@"), word, F.lit(".example."), F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), F.pmod(_number(d, F.lit(28)), F.lit(3)))))
            .when((type_ == "ip") & (attempt > 0), F.concat((F.pmod(_number(d, F.lit(4)), F.lit(16)) + 240).cast("string"), F.lit("."), byte(1), F.lit("."), byte(2), F.lit("."), byte(3)))
            .when(type_ == "ip", F.concat(F.lit("10."), byte(1), F.lit("."), byte(2), F.lit("."), F.pmod(_number(d, F.lit(3)), F.lit(254)).cast("string")))
            .when(type_ == "card", _card(F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(like, F.lit(2)))))
            .when(type_ == "access_key", F.concat(F.substr(value, F.lit(1), F.lit(4)), F.substr(like, F.lit(5))))
            .when((type_ == "phone") & value.startswith("+"), F.concat(F.regexp_extract(value, r"^\+\d{1,3}(?=\D)|^\+\d", 0), F.substr(like, F.length(F.regexp_extract(value, r"^\+\d{1,3}(?=\D)|^\+\d", 0)) + 1)))
            .when(type_ == "name", _name(value, female, d, attempt))
            .otherwise(like)
        )

    return bound(_digest(F.lit(key), type_, F.when(female, "f").otherwise("m"), value, attempt.cast("string")), of)


def surrogate_table(values: DataFrame, key: str, attempts: int = 30) -> DataFrame:
    """(type, value, female, surrogate): distinct surrogates for distinct (type, value, female), none of which is a value.

    Each redraw is from a larger space (names, IP addresses) or the same one; it fails only if values nearly fill their format.
    """
    own = ["type", "value", "female"]
    draw = surrogate(F.col("type"), F.col("value"), F.col("female"), key, F.col("n"))
    drawn = materialize(values.withColumn("n", F.lit(0)).withColumn("surrogate", draw), "surrogates")
    taken = values.select(F.col("value").alias("surrogate")).distinct()
    for _ in range(attempts):
        first = drawn.groupBy("surrogate").agg(F.min(F.struct(*own)).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("surrogate", "first")
        shared = drawn.join(first, "surrogate").filter(F.struct(*own) != F.col("first")).select(*own)
        real = drawn.join(taken, "surrogate", "left_semi").select(*own)
        clash = materialize(shared.unionByName(real).distinct(), "clashes")
        if not clash.take(1):
            return drawn.select(*own, "surrogate")
        again = drawn.join(clash.withColumn("hit", F.lit(True)), own, "left").withColumn("n", F.col("n") + F.coalesce(F.col("hit").cast("int"), F.lit(0)))
        new = materialize(again.withColumn("surrogate", F.when(F.col("hit"), draw).otherwise(F.col("surrogate"))).drop("hit"), "surrogates")
        drop_tables(drawn, clash)
        drawn = new
    raise RuntimeError(f"surrogates still clash after {attempts} attempts")


def _same(type_: Column, value: Column) -> Column:
    """The form under which mentions are one entity."""
    return F.when(type_.isin("email", "hex"), F.lower(value)).otherwise(value)


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates for the entities in its text; adds n_entities and entity_types (sorted, different ones)."""
    docs = one_row_per_doc(docs)
    columns = [c for c in docs.columns if c not in ("n_entities", "entity_types")]
    others = [docs[f"`{c}`"] for c in columns if c not in ("doc_id", text_col)]
    docs = docs.select("doc_id", F.col(text_col).alias("text"), F.struct(*others, F.lit(0)).alias("others"))  # no name of theirs can clash
    found = docs.select("doc_id", mentions(F.col("text")).alias("m")).filter(F.size("m") > 0)
    rows = found.select("doc_id", F.explode(F.array_distinct("m")).alias("raw")).withColumn("type", kind(F.col("raw")))
    rows = rows.withColumn("female", (F.col("type") == "name") & F.col("raw").rlike(rf"^(?:{FEMALE})\b"))
    rows = rows.withColumn("prefix", F.when(F.col("type").isin("name", "password"), F.regexp_extract("raw", PREFIX, 0)).otherwise(""))
    rows = materialize(rows.withColumn("value", _same(F.col("type"), F.substr("raw", F.length("prefix") + 1))), "mentions")
    table = surrogate_table(materialize(rows.select("type", "value", "female").distinct(), "values"), key)
    made = materialize(rows.join(table, ["type", "value", "female"]).select("doc_id", "type", "raw", "value", "surrogate", F.concat("prefix", "surrogate").alias("new")), "replaced")
    per_doc = made.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("whole"), F.array_sort(F.collect_set("type")).alias("types"))
    parts = made.filter("type = 'name'").select("doc_id", "raw", F.explode(F.arrays_zip(F.split("value", " ").alias("word"), F.split("surrogate", " ").alias("new"))).alias("p"))
    parts = parts.filter("p.word is not null and p.new is not null").groupBy("doc_id", "p.word").agg(F.min_by("p.new", "raw").alias("new"))
    parts = parts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "new"))).alias("parts"))
    df = docs.join(per_doc.join(parts, "doc_id", "left"), "doc_id", "left")
    t = F.coalesce(F.col("text"), F.lit(""))

    def woven(between: Column, matches: Column, table: Column) -> Column:
        """Text from what is between matches and what the table has for them; a match that it lacks stays."""
        return F.array_join(F.zip_with(between, matches, lambda a, b: F.concat(a, F.coalesce(F.element_at(table, b), b, F.lit("")))), "")

    def later(text: Column) -> Column:
        """A stretch of text without finds, with the words of the document's names replaced."""
        return F.when(F.col("parts").isNull(), text).otherwise(woven(F.split(text, LATER, -1), F.regexp_extract_all(text, F.lit(LATER), F.lit(0)), F.col("parts")))

    plain = F.col("whole").isNull()
    out = df.withColumn("m", F.when(plain, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    new = F.when(plain, F.col("text")).otherwise(woven(F.transform(F.split(t, ANY, -1), later), F.col("m"), F.col("whole")))
    own = {"doc_id": F.col("doc_id"), text_col: new}
    kept = [own[c].alias(c) if c in own else F.col("others").getField(c).alias(c) for c in columns]
    return out.select(*kept, F.size("m").cast("long").alias("n_entities"), F.coalesce("types", F.array().cast("array<string>")).alias("entity_types"))
