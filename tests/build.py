"""Small observation streams for tests."""

import random

from sessionlab import schemas as S

NAMES = [p.split()[0] for p in S.OBS_DDL.split(",")]
MS = 1_000_000
BLANK = dict(available=True, world="w", has_pos=True, has_look=True, ground=True, clear=True, flat=True, source=True, destination=True, item=False, sprint=False,
             speed=0.1, friction=0.6, jump=0.42, x=0.0, y=64.0, z=0.0, yaw=0.0, pitch=0.0, rotation=True, target_player=True, ping=0)


def event(session, ordinal, ns, kind, **more):
    e = dict(BLANK, trial=str(session), session=session, ordinal=ordinal, ns=ns, epoch_ms=ns // MS, server_tick=0, kind=kind, packet=ordinal, batch=ordinal, sampled_ns=ns)
    e.update(more)
    return e


def frame(spark, events):
    return spark.createDataFrame([tuple(e.get(n) for n in NAMES) for e in events], S.OBS_DDL)


def moves(n, step_ms=50, session=1, pause_at=None, pause_ms=1000, **more):
    out, ns = [event(session, 1, 0, S.SESSION_START, player="p", protocol=47, model=10808)], 0
    for i in range(n):
        ns += pause_ms * MS if i == pause_at else 0
        out.append(event(session, i + 2, ns, S.MOVE, yaw=float(i % 90), **more))
        ns += int(step_ms * MS)
    return out


def messy(seed, n=400, sessions=3):
    """Irregular sessions: regressions in runs, gaps, boundaries, stale snapshots, attacks out of order."""
    rng = random.Random(seed)
    out = []
    for s in range(1, sessions + 1):
        ns, packet = 0, 0
        for o in range(1, n + 1):
            ns += rng.choice([20, 50, 50, 50, 60, 900 if rng.random() < 0.05 else 50]) * MS
            packet = packet - rng.randint(0, 2) if rng.random() < 0.06 else packet + rng.randint(1, 3)
            kind = rng.choices([S.MOVE, S.ATTACK, S.TICK, S.CORRECTION], [70, 22, 7, 0.7])[0]
            at = ns - 30 * MS if kind == S.ATTACK and rng.random() < 0.02 else ns
            out.append(event(s, o, at, kind, packet=packet, sampled_ns=at + (200 * MS if rng.random() < 0.004 else 5), yaw=rng.uniform(-180, 180),
                             has_look=rng.random() < 0.5, ground=rng.random() < 0.5))
    return out
