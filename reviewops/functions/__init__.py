"""Column functions (JVM-side expressions; the only Python one is H2)."""

from reviewops.functions.text import *  # noqa: F401,F403
from reviewops.functions.values import *  # noqa: F401,F403
from reviewops.functions.scores import *  # noqa: F401,F403
