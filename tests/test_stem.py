"""Stems against the published sample of the rules, and each step's conditions."""

import pytest

from stagefork.functions.stem import with_stems

SAMPLE = """
consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist,
consistently consist, consisting consist, consists consist, consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol,
consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol, consonant conson,
consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir,
conspirators conspir, conspire conspir, conspired conspir, conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc,
constant constant, knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee,
kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight,
knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock,
knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot
"""
RULES = """
skis ski, skies sky, dying die, news news, only onli, sky sky, caresses caress, ties tie, cries cri, gas gas, this this, gaps gap, kiwis kiwi, gus gus,
abyss abyss, inning inning, innings inning, proceed proceed, exceeding exceed, agreed agre, feed feed, luxuriated luxuri, hopping hop, hoping hope, hoped hope, bed bed,
shed shed, shred shred, bring bring, say say, by by, cry cri, enjoy enjoy, toying toy, relational relat, conditional condit, rational ration, valenci valenc,
digitizer digit, radically radic, vietnamization vietnam, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, formality formal, sensibility sensibl,
analogy analog, apology apolog, ogi ogi, gently gentl, friendly friend, truly truli, early earli, formative format, talkative talkat, formalize formal, electrical electr, goodness good,
revival reviv, allowance allow, airliner airlin, adjustable adjust, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, onion onion,
communism communism, activate activ, homologous homolog, effective effect, generate generat, generic generic, general general, generously generous, community communiti,
arsenal arsenal, probate probat, rate rate, cease ceas, controlling control, roll roll, bias bias, y y, yes yes, youth youth, boy boy, boyish boyish, syzygy syzygi, a1s a1, été été, cats cat, universities univers
"""


def pairs(text):
    return [tuple(p.split()) for p in text.replace("\n", " ").split(",")]


@pytest.mark.parametrize("text", [SAMPLE, RULES])
def test_known_stems(spark, text):
    want = dict(pairs(text))
    rows = with_stems(spark.createDataFrame([(w, 1) for w in want], "term string, n int")).collect()
    assert {r["term"]: r["stem"] for r in rows} == want and all(r["n"] == 1 for r in rows)


def test_nulls_and_apostrophes(spark):
    rows = with_stems(spark.createDataFrame([(None,), ("",), ("'dogs'",), ("dog's",), ("dogs's'",)], "term string")).collect()
    assert {r["term"]: r["stem"] for r in rows} == {None: None, "": "", "'dogs'": "dog", "dog's": "dog", "dogs's'": "dog"}
