"""The reports in plain Python, straight from their definition, for small inputs."""

from collections import Counter, defaultdict
from fractions import Fraction

POINTS = {
    "q5": Fraction(5, 100),
    "q10": Fraction(10, 100),
    "q25": Fraction(25, 100),
    "median": Fraction(50, 100),
    "q75": Fraction(75, 100),
    "q90": Fraction(90, 100),
    "q95": Fraction(95, 100),
}


def resolve(definitions, concepts, ancestors):
    """``concepts`` maps id to invalid_reason, ``ancestors`` holds (ancestor, descendant)."""
    kept, dropped = set(), set()
    for codeset, concept, deep, excluded in definitions:
        found = {concept} & concepts.keys()
        if deep:
            found |= {d for a, d in ancestors if a == concept and d in concepts and concepts[d] is None}
        (dropped if excluded else kept).update((codeset, c) for c in found)
    return kept - dropped


def distribution(values, min_count=5, saturate=9999):
    """min, quantiles and max of ``values``; a rank below the threshold counts as ``saturate``."""
    n = len(values)
    if n < min_count:
        return (-min_count, *[None] * 9)
    ranked = list(enumerate(sorted(values), start=1))

    def quantile(p):
        if saturate is None:
            return min(v for rank, v in ranked if rank >= p * n)
        return min(saturate if rank < p * n else v for rank, v in ranked)

    return (n, min(values), *[quantile(p) for p in POINTS.values()], max(values))


def nearest(start, dates):
    return min(((d - start).days for d in dates), key=lambda days: (abs(days), days))


class Cohort:
    """Events are lists of (person, concept, date); ``sets`` maps a concept set to its concepts."""

    def __init__(self, measurements, conditions, drugs, sets, disease):
        others = sets[13] - sets[disease]
        self.index, self.sick, self.other, self.drugs = {}, defaultdict(list), defaultdict(list), defaultdict(list)
        for person, concept, date in measurements:
            if concept in sets[6]:
                self.index[person] = min(date, self.index.get(person, date))
        for person, concept, date in conditions:
            if concept in sets[disease]:
                self.sick[person].append(date)
            if concept in others:
                self.other[person].append((concept, date))
        for person, concept, date in drugs:
            if concept in sets[11]:
                self.drugs[person].append(date)

    def members(self):
        return [p for p in self.index if p in self.sick]

    def days_to_diagnosis(self, **limits):
        days = [nearest(self.index[p], self.sick[p]) for p in self.members()]
        return {distribution(days, **limits)} if days else set()

    def days_to_diagnosis_clean(self, **limits):
        days = [nearest(self.index[p], self.sick[p]) for p in self.members() if p not in self.other]
        return {distribution(days, **limits)} if days else set()

    def exclusion_counts(self, names, min_count=5):
        repeats = defaultdict(list)
        for p in self.members():
            for concept, n in Counter(c for c, _ in self.other.get(p, ())).items():
                repeats[concept].append(n)
        rows = []
        for concept, ns in repeats.items():
            more = [sum(n > k for n in ns) for k in (1, 2, 3)]
            if concept in names:
                rows.append(
                    (
                        names[concept],
                        len(ns) if len(ns) >= min_count else -min_count,
                        *[m if m >= min_count else None for m in more],
                    )
                )
        return set(rows)

    def exclusion_days(self, names, **limits):
        days = defaultdict(list)
        for p in self.members():
            dates = defaultdict(list)
            for concept, date in self.other.get(p, ()):
                dates[concept].append(date)
            for concept, found in dates.items():
                days[concept].append(nearest(self.index[p], found))
        rows = set()
        for concept, values in days.items():
            if concept in names:
                n, *statistics = distribution(values, **limits)
                rows.add((n, concept, names[concept], *statistics))
        return rows

    def time_to_treatment(self, **limits):
        days = []
        for p in self.members():
            if p not in self.other:
                after = [(d - self.index[p]).days for d in self.drugs.get(p, ()) if d >= self.index[p]]
                if after:
                    days.append(min(after))
        return {distribution(days, **limits)} if days else set()
