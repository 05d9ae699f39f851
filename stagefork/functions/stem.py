"""Stems of English words by the Porter2 rules, as Column expressions over a table of distinct terms.

A word's regions R1 and R2 are the places behind its first and second run of a vowel and
a consonant. Each step looks for the longest of its endings and replaces it where the
ending lies in the step's region. A vocabulary is stemmed once and joined as a dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The published rules' endings with what takes their place, and words that they don't fit.
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion",
    "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous",
    "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
#: A short syllable at the end; Y is a y that counts as a consonant.
SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _ending(word: Column, names) -> Column:
    """The longest of `names` that the word ends in, else an empty string."""
    return F.regexp_extract(word, f"({'|'.join(sorted(names, key=len, reverse=True))})$", 1)


def _without(word: Column, n: Column | int) -> Column:
    return F.left(word, F.length(word) - n)


def _behind(word: Column) -> Column:
    """Length up to and with the first consonant behind a vowel; the whole length without one."""
    head = F.length(F.regexp_extract(word, "^[^aeiouy]*[aeiouy]+[^aeiouy]", 0))
    return F.when(head > 0, head).otherwise(F.length(word))


def _replaced(word: Column, end: Column, table: dict[str, str], may: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.when((end != "") & may, F.concat(_without(word, F.length(end)), F.try_element_at(known, end))).otherwise(word)


def with_stems(words: DataFrame, term: str = "term", to: str = "stem") -> DataFrame:
    """`words` with a column `to`: the stem of `term`, which is lower-cased already; null where that is null.

    Terms of one or two letters stay; letters beyond a-z and digits count as consonants.
    """
    columns = [F.col(c) for c in words.columns]
    w, r1, r2, end, cut = (F.col(c) for c in ("_w", "_r1", "_r2", "_end", "_cut"))
    step = lambda df, **new: df.select(*columns, *(F.col(c) for c in df.columns[len(columns):] if c not in new), *(v.alias(k) for k, v in new.items()))
    df = words.select(*columns, F.regexp_replace(F.regexp_replace(F.regexp_replace(term, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y").alias("_w"))
    df = step(df, _r1=F.when(w.rlike(f"^({'|'.join(PREFIXES)})"), F.length(F.regexp_extract(w, f"^({'|'.join(PREFIXES)})", 1))).otherwise(_behind(w)))
    df = step(df, _r2=r1 + _behind(F.substring(w, r1 + 1, F.length(w))))
    df = step(df, _w=F.regexp_replace(w, "('s'|'s|')$", ""))
    # Plurals.
    df = step(df, _w=F.when(w.endswith("sses"), _without(w, 2)).when(w.rlike("(ied|ies)$"), F.when(F.length(w) > 4, _without(w, 2)).otherwise(_without(w, 1)))
              .when(w.rlike("(us|ss)$"), w).when(w.rlike("[aeiouy].+s$"), _without(w, 1)).otherwise(w))
    df = step(df, _done=w.isin(*AFTER_PLURAL))
    # Past and continuous forms.
    df = step(df, _end=_ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed")))
    df = step(df, _cut=_without(w, F.length(end)))
    fixed = (F.when(cut.rlike("(at|bl|iz)$"), F.concat(cut, F.lit("e"))).when(cut.rlike(DOUBLE), _without(cut, 1))
             .when(cut.rlike(SHORT) & (r1 >= F.length(cut)), F.concat(cut, F.lit("e"))).otherwise(cut))
    df = step(df, _w=F.when(F.col("_done") | (end == ""), w).when(end.startswith("eed"), F.when(F.length(cut) >= r1, F.concat(cut, F.lit("ee"))).otherwise(w))
              .when(cut.rlike("[aeiouy]"), fixed).otherwise(w))
    df = step(df, _w=F.when(~F.col("_done") & w.rlike("^.+[^aeiouy][yY]$"), F.concat(_without(w, 1), F.lit("i"))).otherwise(w))
    in_r1, in_r2 = F.length(w) - F.length(end) >= r1, F.length(w) - F.length(end) >= r2
    df = step(df, _end=_ending(w, STEP_2))
    df = step(df, _w=_replaced(w, end, STEP_2, ~F.col("_done") & in_r1 & ((end != "ogi") | w.endswith("logi")) & ((end != "li") | w.rlike("[cdeghkmnrt]li$"))))
    df = step(df, _end=_ending(w, STEP_3))
    df = step(df, _w=_replaced(w, end, STEP_3, ~F.col("_done") & in_r1 & ((end != "ative") | in_r2)))
    df = step(df, _end=_ending(w, STEP_4))
    df = step(df, _w=F.when(~F.col("_done") & (end != "") & in_r2 & ((end != "ion") | w.rlike("[st]ion$")), _without(w, F.length(end))).otherwise(w))
    last = F.length(w) - 1
    drop = (w.endswith("e") & ((last >= r2) | ((last >= r1) & ~_without(w, 1).rlike(SHORT)))) | (w.endswith("ll") & (last >= r2))
    df = step(df, _w=F.when(~F.col("_done") & drop, _without(w, 1)).otherwise(w))
    known = F.create_map(*(F.lit(x) for pair in WHOLE.items() for x in pair))
    whole = F.when(F.length(term) <= 2, F.col(term)).otherwise(F.coalesce(F.try_element_at(known, F.col(term)), F.translate(w, "Y", "y")))
    return df.select(*columns, whole.alias(to))


def stem_dimension(words: DataFrame, term: str = "term") -> DataFrame:
    """`term`, stem of the distinct terms of `words`.

    The aggregate on top keeps conditions on a stem from being pushed into its rules,
    where Spark would write them out once for every use.
    """
    return with_stems(words.select(term).distinct(), term).groupBy(term).agg(F.max("stem").alias("stem"))
