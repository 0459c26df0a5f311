"""The running account against a plain simulation, order by order."""

import random

import pytest

from wickwork.operators import account

KINDS = {"order_id": "string", "side": "string", "can_short": "boolean"} | {c: "long" for c in ("signal_no", "fill_no", "exit_no", "exit_rest")}


def orders(seed, n=60):
    r = random.Random(seed)
    out = []
    for key in ("a", "b"):
        for i in range(n if key == "a" else 5):
            s = 2 * i + 1
            price, leave = 50 + r.random() * 20, r.choice([None, s + r.randint(1, 30)])
            o = dict(
                order_id=f"{key}{i:03d}", signal_no=s, side=r.choice(["buy", "buy", "sell"]), close=price, size_fixed=r.choice([0.0, 3.0]), size_share=0.02 / price * r.random() * 30, unit_margin=price * 2, can_short=key == "b", fill_no=r.choice([s + 1, s + 1, None]),
                entry_price=price * 1.001, entry_fee=r.choice([0.0, 0.2, -0.01]), exit_no=leave, exit_price=price * r.uniform(0.8, 1.2), exit_fee=0.1, fee_minimum=r.choice([None, 1.0]), exit_rest=r.choice([0, 4]), contract_size=2.0, leverage=r.choice([1.0, 5.0]), annual_rate=r.choice([0.0, 5.0]),
                paid_signal=s * 3.0, paid_fill=(s + 1) * 3.0, paid_exit=(leave or 0) * 3.0,
            )
            out.append((key, o))
    return out


def simulate(rows, cash, flat_only):
    """Trades are kept as a list and everything is added up anew at each order."""
    events, out = [], []
    for _, o in rows:
        events.append((o["signal_no"], 3, o["order_id"], o))
        if o["fill_no"] is not None:
            events.append((o["fill_no"], 2, o["order_id"], o))
        if o["exit_no"] is not None:
            events.append((o["exit_no"], 1, o["order_id"], o))
    size, open_, ready = {}, [], -1
    fee = lambda q, unit, o: q * unit if o["fee_minimum"] is None or not q else max(q * unit, o["fee_minimum"])
    sign = lambda o: 1 if o["side"] == "buy" else -1
    for no, phase, i, o in sorted(events, key=lambda e: e[:3]):
        if phase == 3:
            unreal = sum((o["close"] - t["entry_price"]) * sign(t) * size[t["order_id"]] * t["contract_size"] for t in open_)
            carry = sum(size[t["order_id"]] * t["contract_size"] * t["annual_rate"] / 365 * (o["paid_signal"] - t["paid_fill"]) for t in open_)
            equity, used = cash + unreal - carry, sum(size[t["order_id"]] * t["entry_price"] * t["contract_size"] / t["leverage"] for t in open_)
            q = abs(o["size_fixed"] + o["size_share"] * equity)
            if (flat_only and open_) or no < ready:
                status, q = ("held" if open_ else "resting"), 0.0
            elif o["side"] == "sell" and not o["can_short"] and not open_:
                status = "short"
            elif q * o["unit_margin"] > equity - used + 1e-9:
                status = "margin"
            else:
                status = "accepted"
                size[i] = q
            out.append((i, status, len(open_), round(equity, 6), round(used, 6), round(q, 6)))
        elif phase == 2 and i in size:
            cash -= fee(size[i], o["entry_fee"], o)
            open_.append(o)
        elif phase == 1 and o in open_:
            q = size[i]
            cash += (o["exit_price"] - o["entry_price"]) * sign(o) * q * o["contract_size"] - fee(q, o["exit_fee"], o) - q * o["contract_size"] * o["annual_rate"] / 365 * (o["paid_exit"] - o["paid_fill"])
            open_.remove(o)
            ready = no + o["exit_rest"] if o["exit_rest"] else ready
    return out


@pytest.mark.parametrize("flat_only", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_account(spark, seed, flat_only):
    rows = orders(seed)
    schema = ", ".join(["ticker string", *(f"{c} {KINDS.get(c, 'double')}" for c in account.ORDER_COLUMNS)])
    df = spark.createDataFrame([(k, *(o[c] for c in account.ORDER_COLUMNS)) for k, o in rows], schema).repartition(3)
    got = sorted((r["order_id"], r["status"], r["open_trades"], round(r["equity"], 6), round(r["used_margin"], 6) + 0.0, round(r["size"], 6)) for r in account.decide(df, 10_000.0, flat_only, ["ticker"]).collect())
    want = sorted(x for k in "ab" for x in simulate([y for y in rows if y[0] == k], 10_000.0, flat_only))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(a - b) < 1e-4 for g, w in zip(got, want, strict=True) for a, b in zip(g[3:], w[3:], strict=True))
    assert len({w[1] for w in want}) >= (2 if flat_only else 3)


def test_sizes_depend_on_earlier_results(spark):
    """Two orders of equal risk: the second is sized by what the first has won."""
    base = dict(side="buy", close=100.0, size_fixed=0.0, size_share=0.001, unit_margin=100.0, can_short=False, entry_price=100.0, entry_fee=0.0, exit_fee=0.0, fee_minimum=None, exit_rest=0, contract_size=1.0, leverage=1.0, annual_rate=0.0, paid_signal=0.0, paid_fill=0.0, paid_exit=0.0)
    rows = [dict(base, order_id="1", signal_no=1, fill_no=2, exit_no=4, exit_price=110.0), dict(base, order_id="2", signal_no=5, fill_no=6, exit_no=None, exit_price=None)]
    schema = ", ".join(["ticker string", *(f"{c} {KINDS.get(c, 'double')}" for c in account.ORDER_COLUMNS)])
    df = spark.createDataFrame([("a", *(o[c] for c in account.ORDER_COLUMNS)) for o in rows], schema)
    got = {r["order_id"]: (r["equity"], r["size"], r["status"]) for r in account.decide(df, 10_000.0, by=["ticker"]).collect()}
    assert got == {"1": (10_000.0, 10.0, "accepted"), "2": (10_100.0, 10.1, "accepted")}
