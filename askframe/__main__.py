"""``python -m askframe``."""

import sys

from askframe.surfaces.cli import main

sys.exit(main())
