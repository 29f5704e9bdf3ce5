"""Where rows come from and go to: test tables as cache state and command logs, snapshots, binlogs, URL lists."""
