"""Column functions: time, binning, levels and draws, gathered from the operators."""

from tapewright.operators.bars import floored, micros, segment
from tapewright.operators.levels import binned, typical
from tapewright.operators.simulate import in_entry_window
from tapewright.plans.attribution import combo_key, tokens
from tapewright.plans.research import draw

__all__ = ["binned", "combo_key", "draw", "floored", "in_entry_window", "micros", "segment", "tokens", "typical"]
