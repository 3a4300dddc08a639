"""Sources: source trees, notebooks, config files, project settings."""
