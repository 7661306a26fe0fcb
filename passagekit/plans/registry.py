"""All queries of the passage domain, each with the SQL that checks it."""

from __future__ import annotations

from passagekit.plans import oracle
from passagekit.plans.queries import QUERIES

FLAGSHIP = "leg_kinematics"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in oracle.SQL.items() if name in QUERIES}
