from kinweave.plans.analyze import main

raise SystemExit(main())
