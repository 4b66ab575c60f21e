"""Leaks: verbatim, re-parameterised, and what is none."""

from quillon.llm import decontaminate as d

ITEM = "A train leaves London at 9 and travels 120 km before it meets the train that Peter took at 9 from the other town."
OTHER = ITEM.replace("London", "Madrid").replace("9", "7").replace("120", "80").replace("km", "miles").replace("Peter", "Maria")
BROKEN = ITEM.replace("at 9 and", "at 7 and").replace("120", "80")  # 9 stays in the second place
FILL = "some quite ordinary words that no benchmark holds and that go on for a while here. "


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.exact for r in d.leaks(docs, items).collect()}


def test_leaks(spark):
    items = [(0, ITEM), (1, "What is the boiling point of tin?"), (2, "ok"), (3, None), (4, ""), (5, "Define entropy."), (6, "?!")]
    docs = [(1, FILL + ITEM + FILL, 0), (2, FILL + OTHER + FILL, 0), (3, FILL + BROKEN + FILL, 0), (4, FILL * 9, 0), (5, ITEM.upper(), 0), (6, None, 0), (7, "", 0), (8, "So: what is the boiling point of tin? Tell.", 0), (None, ITEM, 0), (1, FILL + ITEM + FILL, 0)]
    docs += [(9, FILL + "Define entropy. " + FILL, 0), (10, "they define entropy here. ok then, not ok", 0), (11, "Quiz\ndefine ENTROPY\n", 0), (12, FILL + "OK!", 0)]
    got = found(spark, docs, items)
    assert got == {(1, 0): True, (2, 0): False, (5, 0): True, (8, 1): True, (9, 5): True, (11, 5): True, (12, 2): True}


def test_parts_and_many_copies(spark):
    words = ITEM.split()
    docs = [(i, FILL + " ".join(words[: len(words) * 3 // 10]), 0) for i in range(5)] + [(100 + i, f"{i} " + FILL * (i % 4) + ITEM, 0) for i in range(60)]
    got = found(spark, docs, [(9, ITEM)])
    assert set(got) == {(100 + i, 9) for i in range(60)}


def test_empty_tables(spark):
    assert found(spark, [], [(0, ITEM)]) == {} and found(spark, [(1, ITEM, 0)], []) == {}


def test_templates():
    assert d.template("He met Anna Berg at 5 km. Then 3.5% of 1,000 kg!")[0] == "he met <name> <name> at <num> <unit> then <num> <unit> of <num> <unit>".split()
    assert d.template(None) == ([], [])


LONG = "Every morning the baker of the village carries 40 loaves from the old mill to the market and sells them for 3 dollars each before noon comes around."


def test_edits_and_parts(spark):
    words = LONG.split()
    inserted, changed, lost = words[:13] + ["really"] + words[13:], words[:13] + ["ancient"] + words[14:], words[:13] + words[14:]
    short = "the cat of my aunt never sleeps on the warm red sofa at night".split()
    docs = [(1, FILL + " ".join(inserted), 0), (2, FILL + " ".join(changed), 0), (3, FILL + " ".join(lost), 0), (4, FILL + " ".join(words[6:]), 0)]
    docs += [(5, FILL + " ".join(short[:7] + ["lies"] + short[8:]) + " " + FILL, 0), (6, FILL + " ".join(short[:6]), 0)]
    got = found(spark, docs, [(0, LONG), (1, " ".join(short))])
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 1)}


def test_long_part_of_a_long_item(spark):
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59))
    docs = [(1, FILL + " ".join(item.split()[:25]), 0), (2, FILL + " ".join(item.split()[:12]), 0)]
    assert set(found(spark, docs, [(0, item)])) == {(1, 0)}


APPLES = "Tom has 5 apples. Ann has 3 apples. Bob has twice as many as Ann. How many apples do Tom, Ann and Bob have?"


def test_copies_in_other_cases_and_with_other_parameters(spark):
    items = [(0, ITEM), (1, APPLES), (2, LONG)]
    named = APPLES.replace("Tom", "Maria").replace("Ann", "Peter").replace("Bob", "Lena").replace("5", "12").replace("3", "7")
    docs, want = [], {}
    for i, text in items:
        words = text.split()
        variants = [text, text.lower(), text.upper(), " ".join(words[: len(words) // 2] + ["indeed"] + words[len(words) // 2 :]), " ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :])]
        for k, v in enumerate(variants):
            docs += [(100 * i + 10 * k, FILL + v + " " + FILL, 0), (100 * i + 10 * k + 1, v, 0)]
            want |= {(100 * i + 10 * k, i): 1, (100 * i + 10 * k + 1, i): 1}
    docs += [(900, FILL + named, 0), (901, FILL + OTHER, 0), (902, FILL * 30, 0), (903, FILL + "Tom and Ann have apples, and Bob has pears.", 0)]
    got = found(spark, docs, items)
    assert set(got) == set(want) | {(900, 1), (901, 0)}


def test_very_long_texts(spark):
    docs = [(1, FILL * 4000 + ITEM + FILL * 4000, 0), (2, "x" * 300_000, 0), (3, "5 km " * 40_000, 0)]
    assert set(found(spark, docs, [(0, ITEM)])) == {(1, 0)}


def test_removal_by_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, FILL + ITEM, 1), (1, FILL, 2), (None, ITEM, 3), (None, None, 4), (2, "", 5)], "doc_id long, text string, row_key int")
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    for few in (d.FEW_LEAKS, 0):
        monkeypatch.setattr(d, "FEW_LEAKS", few)
        got = d.decontaminated(docs, items)
        assert got.columns == docs.columns and sorted(r.row_key for r in got.collect()) == [2, 4, 5]
    assert d.decontaminated(docs, items.where("false")).count() == 5 and d.decontaminated(docs.where("false"), items).count() == 0
