"""SPDX licence expressions: precedence OR < AND < WITH, canonical text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Licence and exception ids that expressions may name, spelt as the list spells them.
IDS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSL-1.0 CC0-1.0 CC-BY-4.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 "
    "Unlicense UPL-1.0 Vim W3C WTFPL Zlib"
).split()
EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Bison-exception-2.2")
_BY_FOLD = {x.casefold(): x for x in (*IDS, *EXCEPTIONS)}
_TOKEN = re.compile(r"\s*(?:(\(|\))|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_LEVEL = {"OR": 1, "AND": 2, "WITH": 3}


def canonical(expression: str) -> str | None:
    """The expression with canonical ids, single spaces and only the needed brackets; null if it is none.

    Operators are settled by precedence on two stacks. Chains of one operator are flat and keep their order.
    """
    values: list[tuple[int, str, bool]] = []  # level, text, whether a simple licence
    operators: list[str] = []
    pos, wants = 0, True
    text = expression.strip()

    def reduce_() -> bool:
        op = operators.pop()
        if len(values) < 2:
            return False
        (rl, right, _), (ll, left, simple) = values.pop(), values.pop()
        level = _LEVEL[op]
        if op == "WITH" and not simple:
            return False
        wrap = lambda lv, s: f"({s})" if lv < level else s
        values.append((level, f"{wrap(ll, left)} {op} {wrap(rl, right)}", False))
        return True

    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            return None
        pos = m.end()
        bracket, word = m.groups()
        if bracket == "(":
            if not wants:
                return None
            operators.append("(")
        elif bracket == ")":
            if wants:
                return None
            while operators and operators[-1] != "(":
                if not reduce_():
                    return None
            if not operators:
                return None
            operators.pop()
        elif word in _LEVEL:
            if wants:
                return None
            while operators and operators[-1] != "(" and _LEVEL[operators[-1]] >= _LEVEL[word]:
                if not reduce_():
                    return None
            operators.append(word)
            wants = True
        else:
            if not wants:
                return None
            known = _BY_FOLD.get(word.removesuffix("+").casefold())
            if "LicenseRef-" in word:
                known = word
            elif known is None or (known in EXCEPTIONS) != bool(operators and operators[-1] == "WITH"):
                return None
            elif word.endswith("+"):
                known += "+"
            values.append((4, known, not known.endswith("+")))
            wants = False
    while operators:
        if operators[-1] == "(" or not reduce_():
            return None
    return values[0][1] if len(values) == 1 and not wants else None


@F.pandas_udf(StringType())
def canonical_spdx(expression: pd.Series) -> pd.Series:
    """Canonical expressions, by distinct text."""
    table = {x: canonical(x) for x in expression.dropna().unique()}
    return expression.map(table)
