"""Copies of benchmark items with some values changed, in other capitals, and with values that do not fit."""

import pytest

from tabloom.llm.contamination import decontaminate

WORDS = (
    "a farmer near the river keeps {a} brown hens in one old wooden barn and sells fresh eggs every morning to people who walk "
    "along that muddy road while children play beside them until late evening when the whole family counts what was earned "
    "before {b} guests arrive for supper and everyone sits down around a very large round table"
)
#: Each window of eight words holds a name.
NAMED = (
    "when Anna met Boris near Cairo they saw Dora walk with Emil past the Forum toward Genoa while Hugo asked old Ivan about "
    "his friend Jonas and then Karla sang for Ludwig until young Maria took Nadia home"
)


@pytest.fixture(scope="module")
def judged(spark):
    def run(item, **docs):
        items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
        rows = spark.createDataFrame(list(enumerate(docs.values())), "doc_id bigint, text string")
        found = {r._row.doc_id: r.contaminated for r in decontaminate(rows, items).collect()}
        return {name: found[n] for n, name in enumerate(docs)}

    return run


def test_a_value_that_does_not_fit_costs_its_windows_only(judged):
    other = "an astronomer counted {a} faint moons through her new telescope and wrote {b} letters"
    same = judged(WORDS.format(a=5, b=5), one=WORDS.format(a=5, b=6), both=WORDS.format(a=8, b=8), none=other.format(a=5, b=5))
    assert same == {"one": True, "both": True, "none": False}
    assert judged(WORDS.format(a=3, b=4), merged=WORDS.format(a=7, b=7)) == {"merged": True}


def test_copies_in_other_capitals(judged):
    found = judged(NAMED, same=NAMED, lower=NAMED.lower(), upper=NAMED.upper(), renamed=NAMED.replace("Anna", "Olga").replace("Hugo", "Pablo"))
    assert found == dict.fromkeys(("same", "lower", "upper", "renamed"), True)
    counted = NAMED.replace("old", "12").replace("young", "30")
    assert judged(counted, lower=counted.lower().replace("12", "15").replace("30", "31")) == {"lower": True}


def test_windows_that_count():
    from tabloom.llm.contamination import agreeing

    literal = [[k, 0, 5, 0] for k in range(3)]
    assert agreeing(literal + [[3, 1, 5, 0, 6, 0], [4, 1, 0, 7, 0, 8]]) == 4
    # Two values of the item on one of the document: the pair of more windows stays.
    assert agreeing([[0, 1, 3, 7], [1, 1, 3, 7], [2, 1, 4, 7]]) == 2
    # A window met at two levels counts once, as equal words.
    assert agreeing([[0, 2, 5, 6], [0, 0, 5], [1, 0]]) == 2
