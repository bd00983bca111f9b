"""Names of the four columns that identify one row of a doubled contest table."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Keys:
    contest: str = "contest"
    side: str = "side"
    opp: str = "opp"
    date: str = "d"

    @property
    def row(self):
        return [self.contest, self.side, self.opp]

    @property
    def all(self):
        return [self.contest, self.side, self.opp, self.date]
