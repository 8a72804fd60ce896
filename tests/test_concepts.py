import random

import pytest

from cohortspan.operators.concepts import concept_masks, concepts_of, difference, resolve, save_codesets, stage_codesets, with_names
from cohortspan.sources.definitions import define, definitions_frame, read_concepts, read_definitions, standard_definitions
from tests import brute
from tests.helpers import make_codesets, values


def vocabulary(spark, concepts, ancestors):
    return (
        spark.createDataFrame(
            [(c, f"name {c}", state) for c, state in concepts.items()],
            "concept_id long, concept_name string, invalid_reason string",
        ),
        spark.createDataFrame(sorted(ancestors), "ancestor_concept_id long, descendant_concept_id long"),
    )


def resolved(spark, definitions, concepts, ancestors):
    return set(values(resolve(definitions_frame(spark, definitions), *vocabulary(spark, concepts, ancestors))))


CONCEPTS = {1: None, 11: None, 12: "D", 13: "U", 2: "D", 21: None, 3: None}
ANCESTORS = {(c, c) for c in CONCEPTS} | {(1, 11), (1, 12), (1, 13), (2, 21), (1, 99)}


@pytest.mark.parametrize(
    "definitions, expected",
    [
        # A listed concept counts even if invalid, a descendant only while valid.
        (define(5, [2, 12]), {2, 12}),
        (define(5, [], [1]), {1, 11}),
        (define(5, [2], [2]), {2, 21}),
        # Unknown concepts never count, neither listed nor as descendants.
        (define(5, [77, 3]), {3}),
        # Descendants are a matter of the concept, not of the set.
        (define(5, [1, 2], [2]), {1, 2, 21}),
        (define(5, [], [1], [11]), {1}),
        (define(5, [], [1], [], [1]), set()),
        # An invalid descendant of an excluded concept survives if it is listed.
        (define(5, [12, 11], [], [], [1]), {12}),
        (define(5, [12, 11], [], [12], [1]), set()),
    ],
)
def test_resolve(spark, definitions, expected):
    assert resolved(spark, definitions, CONCEPTS, ANCESTORS) == {(5, c) for c in expected}


def test_sets_do_not_affect_each_other(spark):
    both = define(1, [], [1], [11]) + define(2, [], [1], [3])
    assert resolved(spark, both, CONCEPTS, ANCESTORS) == {(1, 1), (2, 1), (2, 11)}


@pytest.mark.parametrize("seed", range(3))
def test_resolve_against_brute_force(spark, seed):
    rng = random.Random(seed)
    concepts = {c: rng.choice([None, None, "D"]) for c in range(1, 60)}
    ancestors = {(c, c) for c in concepts} | {(c // k, c) for c in concepts for k in (3, 9) if c // k}
    definitions = [
        row
        for s in range(1, 6)
        for row in define(*[s], *[rng.sample(range(1, 70), rng.randint(0, 6)) for _ in range(4)])
    ]
    assert resolved(spark, definitions, concepts, ancestors) == brute.resolve(definitions, concepts, ancestors)


def test_difference(spark):
    sets = make_codesets(spark, {13: {1, 2, 3}, 12: {2, 9}})
    assert sorted(values(difference(sets, keep=13, minus=12))) == [(1,), (3,)]
    assert sorted(values(difference(sets, keep=13, minus=7))) == [(1,), (2,), (3,)]


def test_names_drop_unknown_concepts(spark):
    concept, _ = vocabulary(spark, {1: None, 2: "D"}, {(1, 1)})
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "concept_id long, m int")
    named = with_names(rows, concept, rows.select("concept_id"))
    assert sorted(values(named)) == [(1, 10, "name 1"), (2, 20, "name 2")]


def test_staged_and_saved_sets(spark):
    doubled = make_codesets(spark, {1: {5, 6}}).union(make_codesets(spark, {1: {5}}))
    staged = stage_codesets(doubled, view="session_sets")
    assert sorted(values(staged)) == [(1, 5), (1, 6)]
    assert spark.table("session_sets").count() == 2
    assert sorted(values(save_codesets(staged, "kept_sets"))) == [(1, 5), (1, 6)]
    replaced = save_codesets(make_codesets(spark, {2: {7}}), "kept_sets")
    assert values(replaced) == [(2, 7)]


def test_a_failed_replacement_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "sets")
    save_codesets(make_codesets(spark, {1: {5, 6}}), "held_sets", path)
    before = spark.table("held_sets")
    failing = make_codesets(spark, {2: set(range(100))}).selectExpr("codeset_id", "if(concept_id = 99, raise_error('lost'), concept_id) AS concept_id")
    with pytest.raises(Exception, match="lost"):
        save_codesets(failing, "held_sets", path)
    assert sorted(values(spark.table("held_sets"))) == [(1, 5), (1, 6)]
    # One who has begun to read goes on over a replacement; a set may come from the table itself.
    save_codesets(spark.table("held_sets").where("concept_id = 5"), "held_sets", path)
    assert sorted(values(before)) == [(1, 5), (1, 6)] and values(spark.table("held_sets")) == [(1, 5)]
    for _ in range(3):
        save_codesets(make_codesets(spark, {3: {1}}), "held_sets", path)
    # The version in use and the one before it; what a failed write left is gone.
    assert len([f for f in (tmp_path / "sets").iterdir() if f.name.startswith("version-")]) == 2


def test_other_tables_are_not_replaced(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS no_sets (a STRING) USING parquet")
    with pytest.raises(ValueError, match="does not hold concept sets"):
        save_codesets(make_codesets(spark, {1: {5}}), "no_sets")


def test_masks(spark):
    sets = make_codesets(spark, {4: {1, 2}, 5: {2, 3}, 6: {9}})
    assert sorted(values(concept_masks(sets, [5, 4]))) == [(1, 2), (2, 3), (3, 1)]
    many = make_codesets(spark, {s: {7} for s in range(63)})
    assert values(concept_masks(many, range(63))) == [(7, 2**63 - 1)]
    for ids in ([], range(64)):
        with pytest.raises(ValueError, match="1 to 63"):
            concept_masks(many, ids)


def test_definitions_from_csv(spark, tmp_path):
    rows = define(4, [1], [2], [3])
    path = str(tmp_path / "sets")
    definitions_frame(spark, rows).write.option("header", True).csv(path)
    assert sorted(values(read_definitions(spark, path))) == sorted(rows)


HEADER = "codeset_id,concept_id,include_descendants,is_excluded"


def read_text(spark, tmp_path, text):
    (tmp_path / "sets.csv").write_text(text)
    return sorted(values(read_definitions(spark, str(tmp_path / "sets.csv"))))


@pytest.mark.parametrize(
    "text, expected",
    [
        (f"{HEADER}\n5,1,1,0\n5,3,0,0\n", [(5, 1, True, False), (5, 3, False, False)]),
        (f"{HEADER}\n5, 1 ,TRUE,false\n", [(5, 1, True, False)]),
        ("concept_id,note,is_excluded,codeset_id,include_descendants\n1,x,0,5,1\n", [(5, 1, True, False)]),
    ],
)
def test_definitions_are_read_by_header(spark, tmp_path, text, expected):
    assert read_text(spark, tmp_path, text) == expected


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("row", ["5,1,,0", "5,1,yes,0", "5,x2,1,0", "5,,1,0", ",1,1,0", "5,1.5,1,0", "99999999999,1,1,0"])
def test_bad_definitions_are_errors(spark, tmp_path, row, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="codeset_id|concept_id|include_descendants"):
            read_text(spark, tmp_path, f"{HEADER}\n5,9,0,0\n{row}\n")
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_columns_of_definitions_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="lack is_excluded"):
        read_text(spark, tmp_path, "codeset_id,concept_id,include_descendants\n5,1,1\n")
    (tmp_path / "ids.csv").write_text("name,concept_id\na,7\nb, 8 \n")
    assert sorted(values(read_concepts(spark, str(tmp_path / "ids.csv")))) == [(7,), (8,)]
    (tmp_path / "bad.csv").write_text("concept_id\n7\nx2\n")
    with pytest.raises(Exception, match="x2"):
        read_concepts(spark, str(tmp_path / "bad.csv")).collect()


def test_gaps_in_definitions_are_errors(spark):
    concept, ancestors = vocabulary(spark, {1: None}, {(1, 1)})
    gap = spark.createDataFrame([(5, 1, None, False)], "codeset_id int, concept_id long, include_descendants boolean, is_excluded boolean")
    with pytest.raises(Exception, match="include_descendants"):
        resolve(gap, concept, ancestors).collect()


def test_no_set_named(spark):
    with pytest.raises(ValueError):
        concepts_of(make_codesets(spark, {1: {5}}), *[])


def test_a_table_can_replace_itself(spark, tmp_path):
    first = save_codesets(make_codesets(spark, {1: {5, 6}}), "own_sets", str(tmp_path / "own"))
    again = save_codesets(first.where("concept_id = 5"), "own_sets", str(tmp_path / "own"))
    assert values(again) == [(1, 5)]


def test_standard_definitions(spark):
    nsclc = spark.createDataFrame([(1001,), (1002,)], "concept_id int")
    found = values(standard_definitions(spark, nsclc))
    assert {r[0] for r in values(standard_definitions(spark))} == {r[0] for r in found} - {12}

    def shape(codeset):
        mine = [r for r in found if r[0] == codeset]
        return tuple(sum(1 for r in mine if r[3] is x and (r[2] or not d)) for x in (False, True) for d in (False, True))

    # listed, of which with descendants, excluded, of which with descendants
    assert {s: shape(s) for s in sorted({r[0] for r in found})} == {
        6: (3, 3, 0, 0),
        10: (1, 1, 141, 4),
        11: (1, 1, 0, 0),
        12: (2, 0, 0, 0),
        13: (1, 1, 2, 2),
        14: (1, 1, 0, 0),
        15: (3, 1, 8, 8),
    }
