"""Column expressions: calendar parts, text, numbers and keyed noise. All stay inside Catalyst."""

from forecastops.functions.calendar import *  # noqa: F401,F403
from forecastops.functions.noise import *  # noqa: F401,F403
from forecastops.functions.numeric import *  # noqa: F401,F403
