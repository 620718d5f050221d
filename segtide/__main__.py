from segtide.cli import main

raise SystemExit(main())
