"""Channel layouts as bit maps, and their description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Positions of the D-Cinema scheme, bit 0 first.
POSITIONS = "L R C LFE Ls Rs Lss Rss Lrs Rrs Cs Lc Rc Vhl Vhc Vhr Lts Rts Ts Lw Rw LFE2".split()
_LFE = (POSITIONS.index("LFE"), POSITIONS.index("LFE2"))


def channel_names(bitmap: Column) -> Column:
    """ARRAY of the names whose bit is set."""
    names = F.array(*(F.when(F.shiftright(bitmap, k).bitwiseAND(F.lit(1)) == 1, F.lit(name)) for k, name in enumerate(POSITIONS)))
    return F.filter(names, lambda x: x.isNotNull())


def channel_layout(bitmap: Column) -> Column:
    """``5.1ch(L, R, C, LFE, Ls, Rs)``."""
    lfe = sum((F.shiftright(bitmap, k).bitwiseAND(F.lit(1)) for k in _LFE[1:]), F.shiftright(bitmap, _LFE[0]).bitwiseAND(F.lit(1)))
    names = channel_names(bitmap)
    return F.concat((F.size(names) - lfe).cast("string"), F.lit("."), lfe.cast("string"), F.lit("ch("), F.array_join(names, ", "), F.lit(")"))
