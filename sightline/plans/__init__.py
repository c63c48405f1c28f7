"""sightline.plans"""
