"""Readers of pages that fail on purpose, for the tests of the paged source."""

import os
import re

from quillmere.sources.paged import FormFeed

LOG = os.environ.get("PAGE_LOG", "/tmp/page-log")


class Logged(FormFeed):
    """Notes each range it reads, and cannot read pages that say BROKEN."""

    def pages(self, data, first, last):
        name = re.search(rb"^name=(\w+)", data)[1].decode()
        log = re.search(rb"log=(\S+)", data)[1].decode()
        with open(log, "a") as f:
            f.write(f"{type(self).__name__} {name} {first}-{last}\n")
        found = super().pages(data, first, last)
        if type(self) is Logged and any("BROKEN" in t for t in found):
            raise OSError("broken range")
        return found


class Patient(Logged):
    """Reads what Logged cannot, but for pages that say LOST."""

    def pages(self, data, first, last):
        found = super().pages(data, first, last)
        if any("LOST" in t for t in found):
            raise OSError("lost")
        return found


logged, patient = Logged(), Patient()
