"""Entry point for ``spark-submit run_ingest.py --source … --target …``."""

from wardline.plans.ingest import main

if __name__ == "__main__":
    main()
