"""Plans of accepted suggestions in single cases."""

from shelfmark.operators import accept

FILE = "id int, member_of int, sealed_in int, archive boolean, rule string, confidence double, release_id string, era_id string, slot string, edition string, folder string, seal boolean, readme boolean, rights string, role string, state string"


def file(id, rule="r", confidence=0.9, member_of=None, sealed_in=None, archive=False, release=None, era=None, slot=None, edition=None, folder=None, seal=None, readme=None, rights=None, role=None, state=None):
    return id, member_of, sealed_in, archive, rule, confidence, release, era, slot, edition, folder, seal, readme, rights, role, state


def test_outcomes_and_summary(spark):
    files = spark.createDataFrame([
        file(1, release="R", slot="cd", edition="first", folder="a/b"), file(2, release="R", slot="cd"), file(3, release="R", slot="gone"), file(4, rule=None), file(5, confidence=0.4, era="E"),
        file(6, archive=True, seal=True, era="E", folder="a"), file(7, member_of=6, archive=True, seal=True, rights="own"), file(8, rule=None, member_of=7), file(9, seal=True), file(10, rights="own"), file(11, state="ignored", release="R"), file(12, sealed_in=99, era="E"), file(13, era="E", folder="a"),
    ], FILE)
    plan = accept.decided(files, {"cd"})
    got = {r["id"]: (r["outcome"], r["place"]) for r in plan.collect()}
    assert got == {
        1: ("accepted", "R/cd:first/a/b"), 2: ("accepted", "R/cd:"), 3: ("no type", None), 4: ("none", None), 5: ("unsure", None), 6: ("accepted", "E/a"), 7: ("inside", None), 8: ("inside", None),
        9: ("nothing", None), 10: ("accepted", None), 11: ("ignored", None), 12: ("hidden", None), 13: ("accepted", "E/a"),
    }
    editions = spark.createDataFrame([("R", "cd", "first")], "release string, slot string, name string")
    places = spark.createDataFrame([("R",), ("R/cd:first",), ("E",)], "place string")
    s = accept.summary(plan, files, editions, places).first().asDict()
    assert s == {"accepted": 5, "ignored": 1, "unsure": 1, "none": 1, "no_type": 1, "nothing": 1, "hidden": 1, "inside": 2, "placed": 4, "sealed": 1, "hides": 2, "editions": 1, "folders": 4, "destinations": "E/a (2); R/cd: (1); R/cd:first/a/b (1)"}


def test_one_file_needs_no_confidence(spark):
    one = spark.createDataFrame([file(1, confidence=0.1, era="E")], FILE)
    assert accept.decided(one, set()).first()["outcome"] == "accepted"
    assert accept.decided(one.limit(0), set()).collect() == []
