import sys

from tripleweave.cli import main

sys.exit(main())
