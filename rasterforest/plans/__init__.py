"""Plans that operators share: components and component trees."""
