import sys

from coldlake.cli import main

sys.exit(main())
