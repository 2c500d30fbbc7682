"""spark-submit launcher for the custos jobs.

  zip -r custos.zip custos
  spark-submit --py-files custos.zip custos_job.py series --settings ... --envelope ... --output ...
"""

import sys

from custos.__main__ import main

if __name__ == "__main__":
    main(sys.argv[1:])
