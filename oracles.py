"""DuckDB statements that compute what each registered query computes, formulated independently.

Sets are resolved with EXCEPT, nearest events picked with DISTINCT ON, and quantiles read off sorted
lists, where the library folds flags, uses min_by and cumulates histograms.
"""

from __future__ import annotations

from cohortspan.sources import sample

_DEFS = ",\n    ".join(f"({s}, {c}, {str(d).lower()}, {str(x).lower()})" for s, c, d, x in sample.DEFINITIONS)
_TYPES = ", ".join(f"'{t}'" for t in sample.TYPES)

# Shared steps, in dependency order. Every statement gets all of them; DuckDB skips unused ones.
_STEPS = {
    "coded": f"""
    SELECT p_partkey, p_brand, p_type,
           CAST(split_part(p_brand, '#', 2) AS BIGINT) AS b,
           CAST(list_position([{_TYPES}], p_type) AS BIGINT) AS t,
           CAST(p_size % 4 AS BIGINT) AS z
    FROM part""",
    "leveled": """
    SELECT *, 100 + b AS top, 1000 + 10 * b + t AS mid, 10000 + 100 * b + 10 * t + z AS leaf FROM coded""",
    "vocab": """
    SELECT top AS concept_id, p_brand AS concept_name, CAST(NULL AS VARCHAR) AS invalid_reason FROM leveled
    UNION SELECT mid, p_brand || ' ' || p_type, NULL FROM leveled
    UNION SELECT leaf, p_brand || ' ' || p_type || ' ' || z,
                 CASE WHEN (b + t + z) % 7 = 0 THEN 'D' END FROM leveled""",
    "closure": """
    SELECT top AS ancestor_concept_id, top AS descendant_concept_id FROM leveled
    UNION SELECT top, mid FROM leveled
    UNION SELECT top, leaf FROM leveled
    UNION SELECT mid, mid FROM leveled
    UNION SELECT mid, leaf FROM leveled
    UNION SELECT leaf, leaf FROM leveled""",
    "happened": """
    SELECT o_custkey AS person_id, CASE WHEN b = 8 THEN 108 ELSE leaf END AS concept_id,
           CAST(l_shipdate AS DATE) AS event_date, l_returnflag AS flag
    FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey
    JOIN leveled ON p_partkey = l_partkey""",
    "meas": "SELECT person_id, concept_id, event_date FROM happened WHERE flag = 'A'",
    "cond": "SELECT person_id, concept_id, event_date FROM happened WHERE flag = 'R'",
    "drug": "SELECT person_id, concept_id, event_date FROM happened WHERE flag = 'N'",
    "defs(codeset_id, concept_id, deep, gone)": f"""
    VALUES {_DEFS}""",
    "reach": """
    SELECT codeset_id, d.concept_id, gone, false AS deep FROM defs d JOIN vocab v ON v.concept_id = d.concept_id
    UNION
    SELECT codeset_id, descendant_concept_id, gone, true FROM defs d
    JOIN closure ON ancestor_concept_id = d.concept_id
    JOIN vocab v ON v.concept_id = descendant_concept_id
    WHERE d.deep AND v.invalid_reason IS NULL""",
    "sets": """
    SELECT codeset_id, concept_id FROM reach WHERE NOT gone
    EXCEPT
    SELECT codeset_id, concept_id FROM reach WHERE gone""",
}


def _with(steps: dict[str, str], select: str) -> str:
    every = {**_STEPS, **steps}
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in every.items()) + "\n" + select


_ALL_INDEX = {"idx": "SELECT person_id, min(event_date) AS d0 FROM meas GROUP BY person_id"}


def _cohort(disease: int) -> dict[str, str]:
    return {
        "idx": """
    SELECT person_id, min(event_date) AS d0 FROM meas
    WHERE concept_id IN (SELECT concept_id FROM sets WHERE codeset_id = 6) GROUP BY person_id""",
        "dx": f"""
    SELECT * FROM cond WHERE concept_id IN (SELECT concept_id FROM sets WHERE codeset_id = {disease})""",
        "others": f"""
    SELECT concept_id FROM sets WHERE codeset_id = 13
    EXCEPT SELECT concept_id FROM sets WHERE codeset_id = {disease}""",
        "bad": "SELECT * FROM cond WHERE concept_id IN (SELECT concept_id FROM others)",
        "rx": """
    SELECT * FROM drug WHERE concept_id IN (SELECT concept_id FROM sets WHERE codeset_id = 11)""",
    }


def _closest(events: str, by: str = "", where: str = "") -> str:
    keys = "person_id" + (f", {by}" if by else "")
    return f"""
    SELECT DISTINCT ON ({keys}) {keys}, datediff('day', d0, event_date) AS days
    FROM {events} JOIN idx USING (person_id) {where}
    ORDER BY {keys}, abs(datediff('day', d0, event_date)), event_date"""


_POINTS = [("q5", ".05"), ("q10", ".10"), ("q25", ".25"), ("median", ".50"), ("q75", ".75"), ("q90", ".90"), ("q95", ".95")]


def _spread(source: str, value: str, by: str = "", cap: int | None = 9999, least: int = 5) -> str:
    """Suppressed distribution of ``days`` in ``source``, from one sorted list per group."""

    def at(p: str) -> str:
        exact = f"v[CAST(ceil({p} * k) AS BIGINT)]"
        return exact if cap is None else f"CASE WHEN {p} * k <= 1 THEN v[1] ELSE least({exact}, {cap}) END"

    columns = [f"min_{value}", *[f"{name}_{value}" for name, _ in _POINTS], f"max_{value}"]
    values = ["v[1]", *[at(p) for _, p in _POINTS], "v[k]"]
    stats = ",\n       ".join(f"CASE WHEN k >= {least} THEN {x} END AS {c}" for x, c in zip(values, columns))
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else "HAVING count(*) > 0"
    return f"""SELECT CASE WHEN k >= {least} THEN k ELSE -{least} END AS n, {key}{stats}
FROM (SELECT {key}list(CAST(days AS BIGINT) ORDER BY days) AS v, count(*) AS k FROM {source} {group}) g"""


def _counts(source: str) -> str:
    def repeated(k: int) -> str:
        return f"CASE WHEN sum((m > {k})::INT) >= 5 THEN CAST(sum((m > {k})::INT) AS BIGINT) END"

    return f"""SELECT concept_id, CASE WHEN count(*) >= 5 THEN count(*) ELSE -5 END AS excluded_patient_count,
       {repeated(1)} AS excluded_patient_count_multiple,
       {repeated(2)} AS excluded_patient_count_multiple_2,
       {repeated(3)} AS excluded_patient_count_multiple_3
FROM (SELECT person_id, concept_id, count(*) AS m FROM {source} GROUP BY person_id, concept_id) r
GROUP BY concept_id"""


_CLEAN = "WHERE person_id NOT IN (SELECT person_id FROM bad)"
_MEMBERS = "person_id IN (SELECT person_id FROM idx) AND person_id IN (SELECT person_id FROM dx)"


def _report_steps(disease: int) -> dict[str, str]:
    """The per-person rows behind each report."""
    return {
        **_cohort(disease),
        "r1": _closest("dx"),
        "r2": _closest("dx", where=_CLEAN),
        "r3": f"SELECT * FROM bad WHERE {_MEMBERS}",
        "r4": _closest("bad", by="concept_id", where=f"WHERE {_MEMBERS}"),
        "r5": f"""
    SELECT person_id, min(datediff('day', d0, event_date)) AS days FROM idx JOIN rx USING (person_id)
    {_CLEAN} AND person_id IN (SELECT person_id FROM dx) AND event_date >= d0
    GROUP BY person_id""",
    }


def _reports(disease: int) -> dict[str, str]:
    steps = _report_steps(disease)
    names = "SELECT s.* EXCLUDE (concept_id), {key}concept_name FROM ({spread}) s JOIN vocab USING (concept_id)"
    return {
        "days_to_diagnosis": _with(steps, _spread("r1", "days_to_diag")),
        "days_to_diagnosis_clean": _with(steps, _spread("r2", "days_to_diag")),
        "exclusion_counts": _with(steps, names.format(key="", spread=_counts("r3"))),
        "exclusion_days": _with(
            steps,
            names.format(
                key="concept_id AS condition_concept_id, ", spread=_spread("r4", "days_to_diag", by="concept_id")
            ),
        ),
        "time_to_treatment": _with(steps, _spread("r5", "days_to_treatment")),
    }


def _suite() -> str:
    parts = []
    for disease, name in ((12, "disease_a"), (15, "disease_b")):
        for report, rows in (("days_to_diagnosis", "r1"), ("days_to_diagnosis_clean", "r2")):
            inner = _with(_report_steps(disease), _spread(rows, "days_to_diag"))
            parts.append(f"SELECT '{name}_{report}' AS report, * FROM ({inner}) s")
    return "\nUNION ALL\n".join(parts)


def _scan(step: str) -> str:
    return _with({}, f"SELECT person_id, concept_id, strftime(event_date, '%Y-%m-%d') AS event_date FROM {step}")


def _set_sizes(events: str) -> str:
    return f"""SELECT concept_id, count(*) AS n_events, count(DISTINCT person_id) AS n_persons
FROM {events} WHERE concept_id IN (SELECT concept_id FROM sets) GROUP BY concept_id"""


# Rows of which the person, the concept or the date cannot be read.
_UNREADABLE = {
    "given": """
    SELECT *, person_id % 41 = 0 AS p, concept_id % 13 = 5 AS c, coalesce(day(event_date) = 31, false) AS d FROM (
        SELECT 'measurement' AS event_table, * FROM meas
        UNION ALL SELECT 'condition_occurrence', * FROM cond
        UNION ALL SELECT 'drug_exposure', * FROM drug) u"""
}


def statements() -> dict[str, str]:
    a = _cohort(12)
    sets = "SELECT codeset_id, concept_id FROM sets"
    everyone = {**_ALL_INDEX, "near": _closest("cond"), "near_by": _closest("cond", by="concept_id")}
    shallow = {
        "listed": "SELECT codeset_id, concept_id FROM reach WHERE NOT gone AND NOT deep",
        "grown": "SELECT DISTINCT codeset_id, concept_id FROM reach WHERE NOT gone",
    }
    found = {
        "scan_measurement": _scan("meas"),
        "scan_condition_occurrence": _scan("cond"),
        "scan_drug_exposure": _scan("drug"),
        "scan_concept": _with({}, "SELECT * FROM vocab"),
        "scan_concept_ancestor": _with({}, "SELECT * FROM closure"),
        "concept_sets_explicit": _with(shallow, "SELECT * FROM listed"),
        "concept_sets_descendants": _with(shallow, "SELECT * FROM grown"),
        "concept_sets_excluding": _with({}, f"{sets} WHERE codeset_id IN (13, 15)"),
        "concept_sets_all": _with({}, sets),
        "concept_sets_view": _with(
            {}, "SELECT codeset_id, count(*) AS n_concepts, min(concept_id) AS lowest, max(concept_id) AS highest FROM sets GROUP BY 1"
        ),
        "codeset_difference": _with(a, "SELECT concept_id FROM others"),
        "events_in_codeset": _with(
            a, "SELECT person_id, concept_id, strftime(event_date, '%Y-%m-%d') AS event_date FROM dx"
        ),
        "laid_out_events": _with(
            a, "SELECT person_id, concept_id, strftime(event_date, '%Y-%m-%d') AS event_date FROM dx"
        ),
        "laid_out_days_to_diagnosis_clean": _with(_report_steps(12), _spread("r2", "days_to_diag")),
        "labelled_events": _with(
            a,
            """SELECT barred, concept_id, count(*) AS n_events, count(DISTINCT person_id) AS n_persons
FROM (SELECT *, false AS barred FROM dx UNION ALL SELECT *, true FROM bad) u GROUP BY barred, concept_id""",
        ),
        "first_event_per_person": _with(a, "SELECT person_id, strftime(d0, '%Y-%m-%d') AS index_date FROM idx"),
        "nearest_event_per_person": _with(everyone, "SELECT * FROM near"),
        "nearest_event_per_person_concept": _with(everyone, "SELECT * FROM near_by"),
        "nearest_event_unless_barred": _with(
            {**a, **_ALL_INDEX}, f"SELECT * FROM ({_closest('dx', where=_CLEAN)}) s"
        ),
        "nearest_barred_event": _with(
            {**a, **_ALL_INDEX}, f"SELECT * FROM ({_closest('bad', by='concept_id', where=f'WHERE {_MEMBERS}')}) s"
        ),
        "exclude_persons": _with(
            {**a, **_ALL_INDEX},
            f"SELECT person_id, strftime(d0, '%Y-%m-%d') AS index_date FROM idx {_CLEAN}",
        ),
        "require_persons": _with(
            {**a, **_ALL_INDEX},
            "SELECT person_id, strftime(d0, '%Y-%m-%d') AS index_date FROM idx WHERE person_id IN (SELECT person_id FROM dx)",
        ),
        "concept_set_masks": _with(
            {}, "SELECT concept_id, CAST(sum(CASE codeset_id WHEN 6 THEN 1 WHEN 11 THEN 2 WHEN 12 THEN 4 WHEN 13 THEN 8 WHEN 15 THEN 16 END) AS BIGINT) AS sets FROM sets GROUP BY 1"
        ),
        "nearest_to_first": _with(everyone, "SELECT * FROM near"),
        "nearest_to_first_unless_barred": _with({**a, **_ALL_INDEX}, f"SELECT * FROM ({_closest('dx', where=_CLEAN)}) s"),
        "days_to_first_of_cohort": _with(
            {**a, **_ALL_INDEX},
            f"""SELECT person_id, min(datediff('day', d0, event_date)) AS days FROM idx JOIN drug USING (person_id)
{_CLEAN} AND person_id IN (SELECT person_id FROM dx) AND event_date >= d0 GROUP BY person_id""",
        ),
        "masked_distribution_wide": _with(
            {
                "far": """SELECT l_orderkey::BIGINT * CASE WHEN l_linenumber % 2 = 0 THEN 1000003 ELSE -7000033 END + l_partkey AS days FROM lineitem"""
            },
            _spread("far", "days", cap=None),
        ),
        "time_to_first_event": _with(
            _ALL_INDEX,
            "SELECT person_id, min(datediff('day', d0, event_date)) AS days FROM idx JOIN drug USING (person_id) WHERE event_date >= d0 GROUP BY person_id",
        ),
        "range_join_on_or_after": _with(
            _ALL_INDEX,
            "SELECT DISTINCT person_id, datediff('day', d0, event_date) AS days FROM idx JOIN drug USING (person_id) WHERE event_date >= d0",
        ),
        "occurrences_per_person_concept": _with(
            {},
            "SELECT person_id, concept_id, count(*) AS n_events, strftime(min(event_date), '%Y-%m-%d') AS first_date FROM cond GROUP BY ALL",
        ),
        "masked_counts": _with({}, _counts("cond")),
        "masked_distribution_global": _with(everyone, _spread("near", "days")),
        "masked_distribution_by_key": _with(everyone, _spread("near_by", "days", by="concept_id")),
        "masked_distribution_uncapped": _with(
            everyone, _spread("near_by", "days", by="concept_id", cap=None, least=20)
        ),
        "masked_distribution_low_cap": _with(everyone, _spread("near_by", "days", by="concept_id", cap=100)),
        "date_coercion": "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS event_date FROM lineitem",
        "days_between": """SELECT l_orderkey, l_linenumber, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
        "cohort_size": _with(a, "SELECT count(DISTINCT person_id) AS n FROM idx WHERE person_id IN (SELECT person_id FROM dx)"),
        "cohort_size_by_concept": _with(
            everyone, "SELECT concept_id, count(DISTINCT person_id) AS n FROM near_by GROUP BY concept_id"
        ),
        "concept_name_lookup": _with(
            a,
            "SELECT concept_id, concept_name, count(*) AS n_events FROM bad JOIN vocab USING (concept_id) GROUP BY ALL",
        ),
        "narrowed_events": _with(
            {},
            "\nUNION ALL\n".join(
                f"SELECT '{name}' AS event_table, * FROM ({_set_sizes(step)}) s"
                for name, step in (("measurement", "meas"), ("condition_occurrence", "cond"), ("drug_exposure", "drug"))
            ),
        ),
        "report_suite": _suite(),
        "definitions_from_file": _with({}, sets),
        "saved_codesets": _with({}, sets),
        "screened_counts": _with(
            _UNREADABLE,
            """SELECT event_table, count(*) AS n_rows, count(*) FILTER (NOT (p OR c OR d)) AS n_good, count(*) FILTER (p) AS n_bad_person,
       count(*) FILTER (c) AS n_bad_concept, count(*) FILTER (d) AS n_bad_date FROM given GROUP BY event_table""",
        ),
        "screened_rejects": _with(
            _UNREADABLE,
            """SELECT event_table, CASE WHEN p THEN 'person' WHEN c THEN 'concept' ELSE 'date' END AS reason,
       CASE WHEN p THEN 'P-' ELSE '' END || person_id AS person_id, CASE WHEN c THEN 'c' ELSE '' END || concept_id AS concept_id,
       CASE WHEN d THEN strftime(event_date, '%d/%m/%Y') ELSE strftime(event_date, '%Y-%m-%d') END AS event_date FROM given WHERE p OR c OR d""",
        ),
        "screened_events": _with(
            _UNREADABLE,
            """SELECT event_table, concept_id, count(*) AS n_events, count(DISTINCT person_id) AS n_persons
FROM given WHERE NOT (p OR c OR d) GROUP BY event_table, concept_id""",
        ),
        "merged_occurrences": _with(
            {},
            "SELECT person_id, concept_id, count(*) AS n_events, strftime(min(event_date), '%Y-%m-%d') AS first_date FROM cond GROUP BY ALL",
        ),
        "merged_masked_counts": _with({}, _counts("cond")),
        "catalog_tables": _with(
            {},
            "\nUNION ALL\n".join(
                f"SELECT '{name}' AS event_table, concept_id, count(*) AS n_events, count(DISTINCT person_id) AS n_persons FROM {step} GROUP BY concept_id"
                for name, step in (("measurement", "meas"), ("condition_occurrence", "cond"), ("drug_exposure", "drug"))
            ),
        ),
    }
    for disease, name in ((12, "disease_a"), (15, "disease_b")):
        for number, (report, sql) in enumerate(_reports(disease).items(), start=1):
            found[f"r{number}_{report}_{name}"] = sql
        found[f"r3_exclusion_counts_ordered_{name}"] = _with(
            _report_steps(disease),
            f"""SELECT s.* EXCLUDE (concept_id), concept_name,
       row_number() OVER (ORDER BY excluded_patient_count DESC, concept_id) AS position
FROM ({_counts("r3")}) s JOIN vocab USING (concept_id)""",
        )
    return found
