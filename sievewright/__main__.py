"""Command line."""

import sys

from sievewright.cli import main

sys.exit(main())
