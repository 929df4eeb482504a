"""A mailbox for tests: files named by their number in a folder, and a list of what was fetched."""

import os


class FolderBox:
    def __init__(self, options):
        self.folder = options["folder"]

    def numbers(self, after, unseen):
        return sorted(int(f.split(".")[0]) for f in os.listdir(self.folder) if f.endswith(".eml") and int(f.split(".")[0]) > after)

    def fetch(self, uid):
        with open(f"{self.folder}/fetched", "a") as log:
            log.write(f"{uid}\n")
        with open(f"{self.folder}/{uid}.eml", "rb") as f:
            return f.read()

    def close(self):
        pass
