"""Shared SQL building blocks of the oracles (same derivations as adapters)."""

from __future__ import annotations

import re

CTE: dict[str, str] = {
    "ev": """SELECT event_id, ts, user_id, event_type, value, user_id % 4 AS session_id FROM events""",
    "rssi": """SELECT session_id, ts, event_type AS beacon, -(40 + value % 50) AS rssi FROM ev""",
    "acc": """SELECT session_id, ts, 1 + value / 1000 AS magnitude FROM ev""",
    "steps": """SELECT session_id, ts, event_id,
        CAST(CAST(sum(floor(value)) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS BIGINT) % 5000 AS DOUBLE) AS cnt
        FROM ev""",
    "press": """SELECT session_id, ts, event_id, event_type AS sensor, 1000 + value % 10 AS hpa FROM ev""",
    "ivl": """SELECT * FROM (SELECT session_id, event_id, ts AS "start",
        lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS "end", event_type AS label, user_id
        FROM ev) WHERE "end" IS NOT NULL""",
    "beacons": """SELECT * FROM (VALUES ('click','Bedroom','2F'), ('error','Office','2F'),
        ('purchase','Kitchen','1F'), ('signup','Bathroom','2F'), ('view','Living','1F')) t(beacon, room, floor)""",
    "pred": """SELECT session_id, ts, event_id, event_type AS reference, value,
        lag(event_type) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prediction FROM ev""",
    "pairs": """SELECT * FROM (VALUES (0,0,1),(1,2,3)) t(pair_id, left_session, right_session)""",
}


def cte(**named: str) -> None:
    """Add building blocks; a block may use every block added before it."""
    for name, body in named.items():
        if name in CTE:
            raise ValueError(f"duplicate CTE {name}")
        CTE[name] = body


def with_ctes(body: str, **local: str) -> str:
    """``body`` preceded by exactly the building blocks it needs."""
    blocks = {**CTE, **local}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if word in blocks and word not in needed:
                needed.add(word)
                visit(blocks[word])

    visit(body)
    if not needed:
        return body
    listed = ", ".join(f"{n} AS ({blocks[n]})" for n in blocks if n in needed)
    return f"WITH {listed} {body}"
