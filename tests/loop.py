"""A small row loop for tests, written apart from the library's own fold."""

import sys
from collections import defaultdict, deque

from tidestep.functions.missing import MISSING


class Loop:
    def __init__(self, rows, logic, by=(), retain=None, sas=False):
        self.rows, self.logic, self.by, self.retain, self.sas = rows, logic, by, dict(retain or {}), sas

    def __getitem__(self, k):
        return self.now.get(k, MISSING)

    def __setitem__(self, k, v):
        v = int(v) if isinstance(v, bool) else v
        self.now[k] = v
        if k in self.retain:
            self.retain[k] = v

    def lag(self, v, n=1):
        q = self.queues[sys._getframe(1).f_lasti, n]
        q.append(v)
        return q.popleft() if len(q) > n else MISSING

    def dif(self, v, n=1):
        q = self.queues[sys._getframe(1).f_lasti, n]
        q.append(v)
        old = q.popleft() if len(q) > n else MISSING
        return MISSING if MISSING in (old, v) else v - old

    def output(self):
        self.out.append(dict(self.now))
        self.did = True

    def delete(self):
        self.gone = True

    def run(self):
        self.out, self.queues = [], defaultdict(deque)
        keys = [tuple(r[b] for b in self.by) for r in self.rows]
        for i, r in enumerate(self.rows):
            self.n, self.eof = i + 1, i + 1 == len(self.rows)
            self.first = {b: i == 0 or keys[i - 1][: k + 1] != keys[i][: k + 1] for k, b in enumerate(self.by)}
            self.last = {b: self.eof or keys[i + 1][: k + 1] != keys[i][: k + 1] for k, b in enumerate(self.by)}
            self.now = {k: MISSING if v is None else v for k, v in r.items()} | self.retain
            self.did = self.gone = False
            self.logic(self)
            if not self.did and not self.gone and not self.sas:
                self.output()
        return self.out
