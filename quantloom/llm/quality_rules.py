"""Line-first cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed; a document that loses more than
`max_loss` of its word characters, or that fails the base rules, is rejected. All work is per row, so there is no shuffle.

- Punctuation: no letter or digit, too many symbols, or a line of LONG_LINE words or more without a mark at its end.
- Navigation: short items between separators. - Boilerplate: nothing but one link, a line of rights with a year, or a stock phrase.

Null or empty text: no words, base_failed, rejected. Repeated rows are judged alike. Other columns pass through, whatever their names;
one that has the name of an output column of `judge` is replaced there.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, let, private, words

MIN_WORDS = 50
MAX_LOSS = 0.3
SYMBOLS = "#*$%&|<>"
#: A line of navigation: at least so many separators, no item longer than ITEM characters.
SEPARATORS, MIN_SEPARATORS, ITEM = "|»›•·", 3, 40
#: A line of so many words or more needs one of these marks at its end.
LONG_LINE, END_MARKS = 8, ".!?…:;,\"'»“”’)]。！？"
LINK = r"^[\x20\x09-\x0D]*(https?://|www[.])[^\x20\x09-\x0D]*[\x20\x09-\x0D]*$"
RIGHTS = r"(?i)(©|\(c\)|copyright)[\x20\x09]{0,3}(19|20)[0-9]{2}"
#: Stock phrases of web pages, in the languages of the documents.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "enable javascript",
    "click here", "sign up for our newsletter", "lorem ipsum", "back to top", "skip to content",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren", "nach oben", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies", "cliquez ici", "haut de page", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "aceptar cookies", "haga clic aquí", "ir al contenido",
)
#: Share of symbols among a line's characters over which the line fails the punctuation rule.
MAX_SYMBOL_SHARE = 0.1
#: So many repeated windows are looked up one by one.
FEW = 24


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def line_fails(line: Column) -> Column:
    """Cheap tests come first, so that most lines are never counted."""
    word, gap = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    symbols = line.rlike(f"[{SYMBOLS}]") & (_count(line, SYMBOLS) > F.length(F.regexp_replace(line, f"{gap}+", "")) * MAX_SYMBOL_SHARE)
    unended = (F.instr(F.lit(END_MARKS), F.right(F.rtrim(line, F.lit(SPACE)), F.lit(1))) == 0) & line.rlike(f"^{gap}*+(?:{word}++{gap}++){{{LONG_LINE - 1}}}{word}")
    navigation = line.rlike(f"(?:[{SEPARATORS}][^{SEPARATORS}]*){{{MIN_SEPARATORS}}}") & ~line.rlike(f"[^{SEPARATORS}]{{{ITEM + 1}}}")
    phrase = let(F.lower(line), lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))
    boilerplate = (line.rlike("(19|20)[0-9]{2}") & line.rlike(RIGHTS)) | line.rlike(LINK) | phrase
    return line.rlike(word) & (~line.rlike(r"[\p{L}\p{N}]") | symbols | navigation | unended | boilerplate)


def _repeat_words(ws: Column) -> Column:
    """Words lying in three-word windows that occur twice or more; windows compare by a 64-bit hash within one document."""
    none = F.lit(0).cast("long")
    window = lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    keys = F.when(F.size(ws) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 3, F.lit(0))), window))

    def places(k: Column, twice: Column) -> Column:
        """Sorted starts of the windows whose hash is in `twice`: by search where that is short, else by sorting hashes with their places."""
        every = F.sequence(F.lit(0), F.size(k) - 1)
        s = F.sort_array(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        by_sort = let(s, lambda s: F.sort_array(F.transform(F.filter(every, lambda i: hit(s, i)), lambda i: F.get(s, i)["p"])))
        return F.when(F.size(twice) <= FEW, F.filter(every, lambda i: F.array_contains(twice, F.get(k, i)))).otherwise(by_sort)

    def hit(s: Column, i: Column) -> Column:
        h = F.get(s, i)["h"]
        return F.coalesce(h == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(h == F.get(s, i + 1)["h"], F.lit(False))

    def repeated(k: Column) -> Column:
        twice = let(F.sort_array(k), lambda s: F.array_distinct(F.filter(s, lambda h, i: F.coalesce(h == F.get(s, i - 1), F.lit(False)))))
        return let(twice, lambda twice: places(k, twice))

    start = F.struct(F.lit(-3).alias("last"), none.alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    fold = lambda k: F.aggregate(repeated(k), start, step, lambda acc: acc["n"])
    # Most texts repeat no window, and then only distinct hashes are counted.
    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), none).otherwise(fold(k)))


def judge(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text."""
    t = F.coalesce(F.col(text), F.lit(""))
    stats = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"), F.length(F.array_join(w, "")).cast("long").alias("c")))
    lines = F.split(t, "\n")
    filled = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    stat, lined = private(docs, "stats", "lined")
    those = lambda test: F.transform(F.filter(lined, test), lambda x: x["line"])
    lost = F.length(F.regexp_replace(F.array_join(those(lambda x: x["fails"]), ""), r"[\x20\x09-\x0D]+", ""))
    made = {
        "n_words": F.col(f"{stat}.n"),
        "word_chars": F.col(f"{stat}.c"),
        "n_symbols": _count(t, SYMBOLS).cast("long"),
        "n_dup_lines": dup,
        "n_repeat_words": F.col(f"{stat}.r"),
        "clean_text": F.array_join(those(lambda x: ~x["fails"]), "\n"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "kept": ~F.col("base_failed") & (lost <= F.col("word_chars") * F.lit(max_loss)),
    }
    out = docs.withColumn(stat, stats).withColumn(lined, F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"))))
    for name, value in made.items():
        out = out.withColumn(name, value)
    return out.drop(stat, lined)


def clean(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of docs."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t")), "t", max_loss)
    # A filter would be pushed below the judging and have it done twice; an empty array gives no row either.
    judged = judged.select("row", "clean_text", F.explode(F.when(F.col("kept"), F.array(F.lit(0)))))
    new = {text: F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return judged.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
