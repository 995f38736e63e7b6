"""The published daily formulas, in the formula language."""

from __future__ import annotations

from loomgrid.functions.expr import Node, parse_formula

# The formulas as they must be computed, in their published order. corr0 is a rolling correlation that is 0
# where it is undefined; where(c, a, b) takes a where c holds; fill(x, k) replaces missing and infinite values;
# zero(x, k) replaces zeros; flag(c) is 1 or 0; comparisons with missing values do not hold.
FORMULAS = {
    "alpha001": "rank(ts_argmax(where(returns < 0, stddev(returns, 20), close) ** 2, 5))",
    "alpha002": "-1 * corr0(rank(delta(log(volume), 2)), rank((close - open) / open), 6)",
    "alpha003": "-1 * corr0(rank(open), rank(volume), 10)",
    "alpha004": "-1 * ts_rank(rank(low), 9)",
    "alpha005": "rank(open - sma(vwap, 10)) * (-1 * abs(rank(close - vwap)))",
    "alpha006": "-1 * corr0(open, volume, 10)",
    "alpha007": "where(adv20 >= volume, -1, -1 * ts_rank(abs(delta(close, 7)), 60) * sign(delta(close, 7)))",
    "alpha008": "-1 * rank(ts_sum(open, 5) * ts_sum(returns, 5) - delay(ts_sum(open, 5) * ts_sum(returns, 5), 10))",
    "alpha009": "where((ts_min(delta(close, 1), 5) > 0) | (ts_max(delta(close, 1), 5) < 0), delta(close, 1), -1 * delta(close, 1))",
    "alpha010": "rank(where((ts_min(delta(close, 1), 4) > 0) | (ts_max(delta(close, 1), 4) < 0), delta(close, 1), -1 * delta(close, 1)))",
    "alpha011": "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))",
    "alpha012": "sign(delta(volume, 1)) * (-1 * delta(close, 1))",
    "alpha013": "-1 * rank(covariance(rank(close), rank(volume), 5))",
    "alpha014": "-1 * rank(delta(returns, 3)) * corr0(open, volume, 10)",
    "alpha015": "-1 * ts_sum(rank(corr0(rank(high), rank(volume), 3)), 3)",
    "alpha016": "-1 * rank(covariance(rank(high), rank(volume), 5))",
    "alpha017": "-1 * (rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(volume / adv20, 5)))",
    "alpha018": "-1 * rank(stddev(abs(close - open), 5) + (close - open) + corr0(close, open, 10))",
    "alpha019": "-1 * sign((close - delay(close, 7)) + delta(close, 7)) * (1 + rank(1 + ts_sum(returns, 250)))",
    "alpha020": "-1 * (rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1)))",
    "alpha021": "where((sma(close, 8) + stddev(close, 8) < sma(close, 2)) | (adv20 / volume < 1), -1, 1)",
    "alpha022": "-1 * delta(corr0(high, volume, 5), 5) * rank(stddev(close, 20))",
    "alpha023": "where(sma(high, 20) < high, -1 * delta(high, 2), 0)",
    "alpha024": "where(delta(sma(close, 100), 100) / delay(close, 100) <= 0.05, -1 * (close - ts_min(close, 100)), -1 * delta(close, 3))",
    "alpha025": "rank(-1 * returns * adv20 * vwap * (high - close))",
    "alpha026": "-1 * ts_max(corr0(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)",
    "alpha028": "scale(corr0(adv20, low, 5) + (high + low) / 2 - close)",
    "alpha029": "ts_min(rank(rank(scale(log(ts_sum(rank(rank(-1 * rank(delta(close - 1, 5)))), 2))))), 5) + ts_rank(delay(-1 * returns, 6), 5)",
    "alpha030": "(1.0 - rank(sign(delta(close, 1)) + sign(delay(delta(close, 1), 1)) + sign(delay(delta(close, 1), 2)))) * ts_sum(volume, 5) / ts_sum(volume, 20)",
    "alpha033": "rank(-1 + open / close)",
    "alpha034": "rank(2 - rank(fill(stddev(returns, 2) / stddev(returns, 5), 1)) - rank(delta(close, 1)))",
    "alpha035": "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))",
    "alpha037": "rank(corr0(delay(open - close, 1), close, 200)) + rank(open - close)",
    "alpha038": "-1 * rank(ts_rank(open, 10)) * rank(fill(close / open, 1))",
    "alpha039": "-1 * rank(delta(close, 7) * (1 - rank(decay_linear(volume / adv20, 9)))) * (1 + rank(sma(returns, 250)))",
    "alpha040": "-1 * rank(stddev(high, 10)) * corr0(high, volume, 10)",
    "alpha041": "(high * low) ** 0.5 - vwap",
    "alpha042": "rank(vwap - close) / rank(vwap + close)",
    "alpha043": "ts_rank(volume / adv20, 20) * ts_rank(-1 * delta(close, 7), 8)",
    "alpha044": "-1 * corr0(high, rank(volume), 5)",
    "alpha045": "-1 * (rank(sma(delay(close, 5), 20)) * corr0(close, volume, 2) * rank(correlation(ts_sum(close, 5), ts_sum(close, 20), 2)))",
    "alpha046": "where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 > 0.25, -1, where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < 0, 1, -1 * delta(close, 1)))",
    "alpha047": "((rank(1 / close) * volume / adv20) * (high * rank(high - close) / (sma(high, 5) / 5))) - rank(vwap - delay(vwap, 5))",
    "alpha049": "where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < -0.1, 1, -1 * delta(close, 1))",
    "alpha050": "-1 * ts_max(rank(corr0(rank(volume), rank(vwap), 5)), 5)",
    "alpha051": "where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < -0.05, 1, -1 * delta(close, 1))",
    "alpha052": "-1 * delta(ts_min(low, 5), 5) * rank((ts_sum(returns, 240) - ts_sum(returns, 20)) / 220) * ts_rank(volume, 5)",
    "alpha053": "-1 * delta(((close - low) - (high - close)) / zero(close - low, 0.0001), 9)",
    "alpha054": "-1 * (low - close) * open ** 5 / (zero(low - high, -0.0001) * close ** 5)",
    "alpha055": "-1 * corr0(rank((close - ts_min(low, 12)) / zero(ts_max(high, 12) - ts_min(low, 12), 0.0001)), rank(volume), 6)",
    "alpha060": "-(2 * scale(rank(((close - low) - (high - close)) * volume / zero(high - low, 0.0001))) - scale(rank(ts_argmax(close, 10))))",
    "alpha061": "flag(rank(vwap - ts_min(vwap, 16)) < rank(corr0(vwap, adv180, 18)))",
    "alpha062": "flag(rank(corr0(vwap, sma(adv20, 22), 10)) < rank(flag((rank(open) + rank(open)) < (rank((high + low) / 2) + rank(high))))) * -1",
    "alpha064": "flag(rank(corr0(sma(open * 0.178404 + low * 0.821596, 13), sma(adv120, 13), 17)) < rank(delta((high + low) / 2 * 0.178404 + vwap * 0.821596, 4))) * -1",
    "alpha065": "flag(rank(corr0(open * 0.00817 + vwap * 0.99183, sma(adv60, 9), 6)) < rank(open - ts_min(open, 14))) * -1",
    "alpha066": "-1 * (rank(decay_linear(delta(vwap, 4), 7)) + ts_rank(decay_linear((low - vwap) / zero(open - (high + low) / 2, 0.0001), 11), 7))",
    "alpha068": "flag(ts_rank(corr0(rank(high), rank(adv15), 9), 14) < rank(delta(close * 0.518371 + low * 0.481629, 1))) * -1",
    "alpha072": "rank(decay_linear(corr0((high + low) / 2, adv40, 9), 10)) / zero(rank(decay_linear(corr0(ts_rank(vwap, 4), ts_rank(volume, 19), 7), 3)), None)",
    "alpha074": "flag(rank(corr0(close, sma(adv30, 37), 15)) < rank(corr0(rank(high * 0.0262 + vwap * 0.9738), rank(volume), 11))) * -1",
    "alpha075": "flag(rank(corr0(vwap, volume, 4)) < rank(corr0(rank(low), rank(adv50), 12)))",
    "alpha077": "min2(rank(decay_linear((high + low) / 2 + high - vwap - high, 20)), rank(decay_linear(corr0((high + low) / 2, adv40, 3), 6)))",
    "alpha078": "rank(corr0(ts_sum(low * 0.352233 + vwap * 0.647767, 20), ts_sum(adv40, 20), 7)) ** rank(corr0(rank(vwap), rank(volume), 6))",
    "alpha081": "flag(rank(log(product(rank(rank(corr0(vwap, ts_sum(adv10, 50), 8)) ** 4), 15))) < rank(corr0(rank(vwap), rank(volume), 5))) * -1",
    "alpha083": "rank(delay((high - low) / (ts_sum(close, 5) / 5), 2)) * rank(rank(volume)) / ((high - low) / (ts_sum(close, 5) / 5) / zero(vwap - close, None))",
    "alpha084": "ts_rank(vwap - ts_max(vwap, 15), 21) ** delta(close, 5)",
    "alpha085": "rank(corr0(high * 0.876703 + close * 0.123297, adv30, 10)) ** rank(corr0(ts_rank((high + low) / 2, 4), ts_rank(volume, 10), 7))",
    "alpha086": "flag(ts_rank(corr0(close, sma(adv20, 15), 6), 20) < rank(open + close - vwap - open)) * -1",
    "alpha094": "-1 * rank(vwap - ts_min(vwap, 12)) ** ts_rank(corr0(ts_rank(vwap, 20), ts_rank(adv60, 4), 18), 3)",
    "alpha095": "flag(rank(open - ts_min(open, 12)) < ts_rank(rank(corr0(sma((high + low) / 2, 19), sma(adv40, 19), 13)) ** 5, 12))",
    "alpha099": "flag(rank(corr0(ts_sum((high + low) / 2, 20), ts_sum(adv60, 20), 9)) < rank(corr0(low, volume, 6))) * -1",
    "alpha101": "(close - open) / ((high - low) + 0.001)",
}


def formula(name: str) -> Node:
    """The tree of a named formula."""
    return parse_formula(FORMULAS[name])
