"""Scalar functions of the language.

There is one, ``now()``: milliseconds since the epoch, read once when a statement is parsed, so that every row sees the
same time and a test can give its own clock.
"""

import time
from collections.abc import Callable


def now_ms(clock: Callable[[], float] = time.time) -> int:
    return int(clock() * 1000)
