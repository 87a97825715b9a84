import sys

from pagemill.cli import main

sys.exit(main())
