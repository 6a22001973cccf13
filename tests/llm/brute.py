"""Helpers of the brute-force tests."""

from collections import defaultdict

SF = "/root/testdata/sf0.001"


def components_of(n, links):
    """Members of each component of the numbers below n."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return groups
