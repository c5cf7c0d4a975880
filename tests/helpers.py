"""Values that the tests share; fixtures are in conftest.py."""

import os
import sys
from datetime import datetime, timezone

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paysleuth.plans.ordered import SplitPolicy  # noqa: E402

# any group with more than a handful of rows is cut
TINY = SplitPolicy(rows_per_segment=4, max_segments=32)
BASE = datetime(2025, 1, 15, 12, 0, tzinfo=timezone.utc)
